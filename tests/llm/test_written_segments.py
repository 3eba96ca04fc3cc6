import glob
import os

from pipewise.llm.suffix_dedup import remove_repeated_bytes
from pipewise.sources.scratch import scratch_dir


def test_segments_are_written_small(spark, docs_of):
    """The texts of segments are most of what op6 keeps on disk."""
    folder = f"{scratch_dir(spark)}/pipewise"
    before = set(glob.glob(f"{folder}/*"))
    text = " ".join(f"some words {k}" for k in range(60))
    rows = remove_repeated_bytes(docs_of([(1, "one " + text), (2, "two " + text)])).collect()
    assert {r["doc_id"]: r["n_removed"] > 0 for r in rows} == {1: False, 2: True}
    new = [p for p in set(glob.glob(f"{folder}/*")) - before if os.path.basename(p).startswith(("places-", "segments-"))]
    files = [f for p in new for f in glob.glob(f"{p}/part-*")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
