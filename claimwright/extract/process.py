"""Extractors that are programs: a file on stdin, its answer as JSON lines on stdout, remarks on stderr.

Asked ``--identify``, a program answers with a line per contract: the protocol number, the
contract's name (which one contract may leave out), its source, the mimes it takes and
whether it derives files. For a file it is started with the contract's name and, if it
derives, a folder for the derived files. A line of its answer is a finding about the file,
the announcement of a derived file, or a finding about one; unknown members, a wrong mix, a
file that was not announced or not written refuse the whole answer, as does a non-zero exit.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
from contextlib import nullcontext
from dataclasses import dataclass

from claimwright.extract.contracts import Contract, Findings

#: The member of an identity that holds the protocol's number; a parameter.
PROTOCOL, NUMBER = "extractor", 1
_NAME = r"[a-z0-9-]+"
_SHAPES = {frozenset({"attribute", "value"}), frozenset({"file", "mime"}), frozenset({"file", "attribute", "value"})}


@dataclass(frozen=True)
class Program:
    """One contract of a program, as a function of a file's bytes."""

    path: str
    contract: str | None
    #: Where derived files wait to be read, below a folder that is shared; None if the contract derives none.
    scratch: str | None

    @property
    def derives(self) -> bool:
        return self.scratch is not None

    def __call__(self, data: bytes) -> Findings:
        with tempfile.TemporaryDirectory(dir=self.scratch) if self.derives else nullcontext() as folder:
            command = [self.path, *([self.contract] if self.contract else []), *([folder] if self.derives else [])]
            ran = subprocess.run(command, input=data, capture_output=True)
            remarks = [re.sub(rf"^{re.escape(os.path.basename(self.path))}: ", "", x) for x in ran.stderr.decode("utf-8", "replace").splitlines()]
            if ran.returncode:
                raise ValueError(f"{os.path.basename(self.path)} failed ({ran.returncode}){': ' if remarks else ''}{'; '.join(remarks)}")
            out = read_answer(ran.stdout.decode("utf-8"), folder if self.derives else None)
            out.remarks += remarks
            return out


def read_answer(answer: str, folder: str | None) -> Findings:
    """The findings of an answer, whole or not at all."""
    out, announced = Findings(), {}
    for number, line in enumerate(answer.splitlines(), 1):
        try:
            row = json.loads(line)
        except ValueError:
            row = None
        if not isinstance(row, dict) or frozenset(row) not in _SHAPES or not all(isinstance(row.get(k, ""), str) for k in ("file", "mime", "attribute")):
            raise ValueError(f"line {number} of the answer is none of the three: {line[:80]}")
        if "attribute" in row and (not re.fullmatch(f"{_NAME}:{_NAME}", row["attribute"]) or row["value"] is None):
            raise ValueError(f"line {number} of the answer: no attribute with a value")
        if "file" not in row:
            out.facts.append((row["attribute"], row["value"]))
        elif "mime" in row:
            name = row["file"]
            if folder is None or name in announced or not name or "/" in name or name in (".", "..") or not os.path.isfile(os.path.join(folder, name)) or os.path.islink(os.path.join(folder, name)):
                raise ValueError(f"line {number} of the answer announces no file of its own: {name}")
            with open(os.path.join(folder, name), "rb") as f:
                announced[name] = f.read(), [("file:mime", row["mime"])]
        elif row["file"] not in announced:
            raise ValueError(f"line {number} of the answer is about a file that was not announced: {row['file']}")
        else:
            announced[row["file"]][1].append((row["attribute"], row["value"]))
    if folder is not None and (left := set(os.listdir(folder)) - set(announced)):
        raise ValueError(f"files were written but not announced: {', '.join(sorted(left))}")
    out.files = list(announced.values())
    return out


def identify(path: str, scratch: str) -> list[Contract]:
    """The contracts of the program at *path*; several must each have a name, no name twice. *scratch* is a folder that all executors share."""
    ran = subprocess.run([path, "--identify"], capture_output=True)
    if ran.returncode:
        raise OSError(f"{path} --identify failed: {ran.stderr.decode('utf-8', 'replace').strip()}")
    rows = [json.loads(line) for line in ran.stdout.decode("utf-8").splitlines()]
    if not rows or any(r.get(PROTOCOL) != NUMBER for r in rows):
        raise ValueError(f"{path} does not speak protocol {NUMBER}")
    names = [r.get("contract") for r in rows]
    if (len(rows) > 1 and None in names) or len(set(names)) < len(names) or not all(re.fullmatch(_NAME, n) for n in names if n):
        raise ValueError(f"{path}: contracts need names of their own")
    return [Contract(r["source"], tuple(r["mimes"]), Program(path, r.get("contract"), scratch if r.get("derives") else None)) for r in rows]
