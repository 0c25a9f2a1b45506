"""Schemas of the engine's tables."""

from __future__ import annotations

RECORD = "struct<kind:string,change:string,name:string,summary:string>"
COMMITS = "repo string, seq bigint, sha string, author string, date_iso string, ts timestamp"
RESULTS = f"{COMMITS}, records array<{RECORD}>, error string"
FILES = "sha string, file_no int, path string, status string, added int, removed int"
SECTIONS = "sha string, sec_no int, old_path string, new_path string, new_file boolean, deleted_file boolean, similarity int, rename_from string, copy_from string, binary boolean, truncated boolean, text string"
LINES = "sha string, sec_no int, hunk_no int, line_no int, tag string, text string, old_line int, new_line int"
ENTRY = "struct<kind:string,name:string,file:string,detail:string,public_entry:boolean>"
BOUNDARY = "struct<kind:string,name:string,line:int,detail:string>"

KINDS = ("cap", "fix", "tend")
CHANGES = ("new", "deepened", "regressed", "removed")
LOSSES = ("regressed", "removed")
