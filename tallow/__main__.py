"""python -m tallow compress IN TEMP OUT: files to archives in TEMP and back to OUT, with sizes and a check of every byte.
python -m tallow query NAME FOLDER: a registered query over the tables in FOLDER."""

from __future__ import annotations

import sys

from tallow.session import session


def main(args: list[str]) -> int:
    if len(args) == 4 and args[0] == "compress":
        from tallow.sources.codec_file import decode_file, encode_file, relative_name
        from tallow.sources.raw import read_bytes

        spark, (given, temp, out) = session(), args[1:]
        rows = encode_file(spark, given, temp).selectExpr("count(*) AS files", "coalesce(sum(raw), 0) AS raw", "coalesce(sum(stored), 0) AS stored").first()
        decode_file(spark, temp, out)
        before, after = (read_bytes(spark, p).select(relative_name(p).alias("name"), "content") for p in (given, out))
        equal = before.join(after, ["name", "content"], "left_anti").isEmpty()
        print(f"files {rows.files}, raw {rows.raw}, stored {rows.stored}, ratio {rows.raw / max(1, rows.stored):.3f}, {'lossless' if equal else 'DIFFERENT'}")
        return int(not equal)
    if len(args) == 3 and args[0] == "query":
        from tallow.plans.queries import QUERIES

        QUERIES[args[1]](session(), args[2]).show(50, truncate=False)
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
