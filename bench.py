"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. Every query is run to its end with all columns, into Spark's no-op sink. Two short
queries come first, so that session start-up is not charged to the first headline.
"""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import inputs as I  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from docspark.operators import lexical  # noqa: E402
from docspark.plans.search import hybrid_search  # noqa: E402
from docspark.session import build_session, materialize, shared_dir  # noqa: E402
from docspark.sources import tables as ST  # noqa: E402

HEADLINE = [
    "r9_hybrid_search", "r4_bm25", "r5_vector_topk", "r1_build_postings", "k1_chunk_pages",
    "a2_tag_counts", "a3_tag_hierarchy", "p1_list_documents", "f3_split_sentences",
    "f5_fallback_summary", "f6b_lead_summary", "f7_key_insights", "k2_keyphrases", "k4_tf_terms", "m1_hash_encoder",
    "c1_classify", "u1_upsert", "x2_latest_progress",
]


def search_stored(spark, d):
    """The hybrid search over a stored index and catalog, which are written outside the clock."""
    docs, vecs = I.documents(spark, d).select("doc_id", "text"), I.vectors(spark, d)
    catalog, path = materialize(I.catalog(spark, d)), shared_dir(spark)
    ST.write_index(vecs.select("chunk_id", "doc_id", "page"), vecs.select("chunk_id", "doc_id", "page", "embedding"),
                   lexical.build_postings(docs, positions=False, lengths=True), path, buckets=8)
    index = ST.read_index(spark, path)
    return lambda: hybrid_search(I.queries(spark, d), catalog, docs, index["vectors"], postings=index["postings"],
                                 headers=index["headers"], parts=index["parts"])


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    for warm in ("f19_file_kind", "k5_frequent_words"):
        QUERIES[warm](spark, d).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t = time.time()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        ready = search_stored(spark, d)
        t = time.time()
        ready().write.format("noop").mode("overwrite").save()
        times["r9_search_stored_index"] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(d).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
