"""A mail service's delta listing: pages of changed messages behind a link that is kept for the next round.

What talks to the service is a function ``get(link) -> (status, headers, body)``, so any client
can take its place. A round follows the pages from the kept link to the next one. A link that
has expired (410) starts the listing anew; 401 asks once for a new token; 408, 429 and 5xx
are tried again, waiting as told or twice as long each time.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

Get = Callable[[str], tuple[int, dict[str, str], dict]]
TRIES, LONGEST = 5, 60.0


@dataclass
class Round:
    """What a round brought: changed messages, ids of removed ones, the link for the next, and whether the listing started anew."""

    changed: list[dict] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    link: str | None = None
    restarted: bool = False


def fetched(get: Get, link: str, renew: Callable[[], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[int, dict]:
    """(status, body) of *link*, with the patience that the service asks for."""
    renewed, wait = False, 1.0
    for attempt in range(TRIES + 1):
        status, headers, body = get(link)
        if status == 401 and renew and not renewed:
            renewed = True
            renew()
            continue
        if status not in (408, 429) and status < 500:
            return status, body
        if attempt < TRIES:
            asked = headers.get("Retry-After", "")
            sleep(min(LONGEST, float(asked)) if asked.isdigit() else wait)
            wait = min(LONGEST, wait * 2)
    raise ConnectionError(f"{link}: status {status} after {TRIES} more tries")


def delta_round(get: Get, start: str, link: str | None = None, renew: Callable[[], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> Round:
    """A round from *link*, or from *start* without one."""
    out, at = Round(), link or start
    while at:
        status, body = fetched(get, at, renew, sleep)
        if status == 410 and not out.restarted:
            out, at = Round(restarted=True), start
            continue
        if status >= 400:
            raise ConnectionError(f"{at}: status {status}")
        for item in body.get("value", []):
            if "@removed" in item:
                out.removed.append(item["id"])
            else:
                out.changed.append(item)
        at, out.link = body.get("@odata.nextLink"), body.get("@odata.deltaLink", out.link)
    return out
