"""python -m tickloom inspect DIR | recover DIR: rows and time bounds of the binary segments in a folder; deletion of unfinished files."""

from __future__ import annotations

import sys

from tickloom.sources.segments import HEADER, SegmentError, header, list_segments, recover


def inspect(folder: str) -> list[str]:
    lines, total = [], 0
    for path in list_segments(folder):
        with open(path, "rb") as f:
            try:
                h = header(f.read(HEADER))
            except SegmentError as e:
                lines.append(f"{path}: {e}")
                continue
        total += h["n"]
        lines.append(f"{path}: {h['n']} rows, time {h['min'][2]:.17g} to {h['max'][2]:.17g}")
    return [*lines, f"total: {total} rows"]


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in ("inspect", "recover"):
        print(__doc__, file=sys.stderr)
        return 2
    print("\n".join(inspect(args[1])) if args[0] == "inspect" else f"{recover(args[1])} unfinished files deleted")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
