"""An archive's mark and configuration, small files that the driver reads."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass

GENERATION = 1
ALGORITHMS = ("sha256", "sha384", "sha512", "blake3")
DIGEST_BITS = {"sha256": 256, "sha384": 384, "sha512": 512, "blake3": 256}


@dataclass(frozen=True)
class Mark:
    """Generation, digest algorithm and how deep the stores are sharded."""

    generation: int
    algorithm: str
    depths: dict[str, int]

    @classmethod
    def read(cls, text: str) -> Mark:
        """The mark of one JSON line. A later generation is told before anything else in it is judged."""
        raw = json.loads(text)
        if not isinstance(raw, dict) or not isinstance(raw.get("generation"), int):
            raise ValueError("no mark")
        if raw["generation"] != GENERATION:
            raise ValueError(f"generation {raw['generation']} is not {GENERATION}")
        if set(raw) != {"generation", "algorithm", "depths"} or raw["algorithm"] not in ALGORITHMS:
            raise ValueError("a mark has generation, algorithm and depths, and no other member")
        if set(raw["depths"]) != {"content", "derived", "claims"} or not all(isinstance(d, int) and 0 <= d <= 4 for d in raw["depths"].values()):
            raise ValueError("depths are those of content, derived and claims, 0 to 4")
        return cls(**raw)


@dataclass(frozen=True)
class Config:
    excludes: tuple[str, ...] = ()
    compress: bool = False
    extractors: tuple[str, ...] = ()

    @classmethod
    def read(cls, text: str) -> Config:
        """A configuration of TOML text; unknown names and wrong kinds are refused."""
        raw = tomllib.loads(text)
        if unknown := set(raw) - {"excludes", "compress", "extractors"}:
            raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
        for name in ("excludes", "extractors"):
            if not isinstance(raw.get(name, []), list) or not all(isinstance(x, str) and x for x in raw.get(name, [])):
                raise ValueError(f"{name} is a list of texts")
        if not isinstance(raw.get("compress", False), bool):
            raise ValueError("compress is true or false")
        return cls(tuple(raw.get("excludes", ())), raw.get("compress", False), tuple(raw.get("extractors", ())))


def shard(digest: str, depth: int) -> str:
    """The path of a digest in a store sharded *depth* levels deep."""
    return "/".join([*(digest[2 * i : 2 * i + 2] for i in range(depth)), digest])
