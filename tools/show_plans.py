"""Write the physical plans of the key operators to PLANS.md.

The catalogue is first stored the way ``write_tables`` stores it (Parquet,
``files`` partitioned by ``store``), so the plans show what a real run reads:
partition filters, pushed filters, read schemas, exchanges and aggregates.

    python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from ledgerwalk.session import ensure_checkpoint_dir, get_spark
    from ledgerwalk.plans import views as V
    from ledgerwalk.sources import read_tables, write_tables
    from ledgerwalk.operators import (DedupRule, JunkRule, build_plan, directory_rollup, identify_all_hashes,
                                      organize_candidates)
    spark = get_spark("local[8]", shuffle_partitions=16, extra_conf={"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    root = f"{ensure_checkpoint_dir(spark)}/plans-{uuid.uuid4().hex}"
    docs = V.docs_tables(spark, sf_dir)
    media = V.media_tables(spark, sf_dir)
    write_tables({**docs, "mime": media["mime"], "exif": media["exif"]}, root + "/docs")
    write_tables(media, root + "/media")
    T = read_tables(spark, root + "/docs")
    M = read_tables(spark, root + "/media")
    cases = {
        "dedup rule (after junk claims)": DedupRule().evaluate(T, JunkRule().claims()),
        "build_plan (junk + dedup)": build_plan(T),
        "directory rollup from the files table": directory_rollup(V.listing_from_files(T["files"])),
        "identify_all_hashes": identify_all_hashes(T["files"], T["mime"]),
        "organize candidates": organize_candidates(M["files"], M["mime"], M["exif"]),
    }
    out = ["# Physical plans of key operators", "",
           f"Generated by `tools/show_plans.py` over `{os.path.basename(sf_dir)}` stored as versioned Parquet "
           "(`files` partitioned by `store`). Before execution, so AQE may still re-plan joins at run time.", ""]
    for title, df in cases.items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = re.sub(r"#\d+L?", "", buf.getvalue())
        text = re.sub(r"file:/[^\]\s,]*", "<path>", text)
        out += [f"## {title}", "", "```", text.strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
