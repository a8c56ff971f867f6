"""Mail headers: unfolding, encoded words, addresses, dates, folder names. Arrow-batched, where no expression can do it."""

from __future__ import annotations

import base64
import re
import unicodedata

from pyspark.sql import DataFrame, functions as F

from claimwright.extract import headers, mime
from claimwright.functions.batched import batched


def decoded_text(text: str | None) -> str | None:
    """A header's text on one line, encoded words decoded; null of null."""
    return None if text is None else mime.unfolded(text.encode("utf-8", "replace"))


def address_list(text: str | None) -> list[str]:
    """One ``Name <address>`` per mailbox of an address list; what is no address is left out."""
    return headers.read("to", text.encode("utf-8", "replace"))[0] if text else []


def address_faults(text: str | None) -> list[str]:
    """Why entries of an address list give no address."""
    return headers.read("to", text.encode("utf-8", "replace"))[1] if text else []


def utf7_decode(name: str | None) -> str | None:
    """A folder name out of the modified UTF-7 of mail servers; a broken shift stays as it is written."""

    def one(m: re.Match) -> str:
        if not m[1]:
            return "&"
        try:
            return base64.b64decode(m[1].replace(",", "/") + "=" * (-len(m[1]) % 4)).decode("utf-16-be")
        except ValueError:
            return m[0]

    return None if name is None else re.sub("&([^-]*)-", one, name)


def utf7_encode(name: str | None) -> str | None:
    def one(m: re.Match) -> str:
        return "&-" if m[0] == "&" else "&" + base64.b64encode(m[0].encode("utf-16-be")).decode().rstrip("=").replace("/", ",") + "-"

    return None if name is None else re.sub("&|[^\x20-\x7e]+", one, name)


def folder_key(name: str | None) -> str | None:
    """A folder name as it is compared: NFC, and INBOX in any case."""
    if name is None:
        return None
    name = unicodedata.normalize("NFC", name)
    return "INBOX" if name.upper() == "INBOX" else name


def fitted(name: str | None, most: int = 240) -> str | None:
    """A file name without controls, cut to *most* bytes between characters, its extension of up to 16 kept."""
    if name is None:
        return None
    name = "".join(c for c in name if unicodedata.category(c) != "Cc")
    if len(name.encode()) <= most:
        return name
    stem, dot, ext = name.rpartition(".")
    ext = dot + ext if stem and len((dot + ext).encode()) <= 16 else ""
    stem = name[: len(name) - len(ext)]
    return stem.encode()[: most - len(ext.encode())].decode("utf-8", "ignore") + ext



mail_date = batched(headers.moment, "string")
decode = batched(decoded_text, "string")
faults = batched(address_faults, "array<string>")
addresses = batched(address_list, "array<string>")
from_utf7 = batched(utf7_decode, "string")
to_utf7 = batched(utf7_encode, "string")
folder = batched(folder_key, "string")
fits = batched(fitted, "string")


def standing_addresses(values: DataFrame) -> DataFrame:
    """Rows (subject, address) of JSON string values (subject, value)."""
    rows = values.select("subject", addresses(F.get_json_object("value", "$")).alias("a"))
    return rows.select("subject", F.explode("a").alias("address")).distinct()
