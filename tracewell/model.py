"""Schemas and options. A detection is one row; every other plane (targets, windows, pages, journals) is relational too."""

from __future__ import annotations

from dataclasses import dataclass

BLOCK, OVERLAP = 4096, 2048
PROFILES = ("", "default", "secrets")

DETECTION = (
    "description string, needle string, offset bigint, target string, block_offset bigint, match_length int, carve_path string,"
    "carve struct<class:string,magic_offset:bigint,size:bigint,entropy_bits:double>,"
    "hashes array<struct<format:string,hash:string,kdf:string,iterations:bigint,salt_hex:string,method:bigint,params:map<string,string>,offset:bigint>>,"
    "words array<string>, file_name string,"
    "salvage struct<path:string,kind:string,page_size:int,pages:array<struct<pgno:bigint,offset:bigint,size:int,kind:string>>,"
    "runs:array<struct<start_offset:bigint,pages:int>>,complete:boolean,ordered:boolean,verdict:string,reasons:array<string>>,"
    "fingerprint string, commit string, path string, line int, verified boolean"
)
REQUIRED = ["description", "needle", "offset", "target", "block_offset", "match_length"]


@dataclass(frozen=True)
class ScanOptions:
    """What a scan does. Matched words appear only with reveal; the secret shapes only with profile "secrets"."""

    start_offset: int = 0
    profile: str = ""
    reveal: bool = False
    context_bytes: int = 4096

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile {self.profile!r}; known: default, secrets")
        if self.start_offset < 0:
            raise ValueError("start_offset is negative")
