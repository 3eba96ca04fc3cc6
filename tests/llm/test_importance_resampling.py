import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from pipewise.llm import importance_resampling as resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, longest):
    own = words(text)
    return [" ".join(own[k : k + n]) for n in range(1, longest + 1) for k in range(len(own) - n + 1)]


def brute(docs, target, percent=10, min_words=20, buckets=10_000, longest=1, seed=2024):
    def counts(texts):
        own = Counter()
        for t in texts:
            own.update(zlib.crc32(f.encode()) % buckets for f in features(t, longest))
        return own

    s, t = counts(x for _, x in docs), counts(target)
    S, T = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets))))

    rows = []
    for i, text in docs:
        own = [zlib.crc32(f.encode()) % buckets for f in features(text, longest)]
        weight = sum(gain(b) for b in own)
        digits = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        u = (int(digits[:8], 16) + 0.5) / 4294967296
        score = weight + math.floor(-1000 * math.log(-math.log(u)))
        rows.append((i, len(own), weight, score, len(words(text)) >= min_words))
    able = sorted([r for r in rows if r[4]], key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    k = len(able) * percent // 100
    ranked = [(*r[:4], n + 1) for n, r in enumerate(able[:k])]
    rest = [(*r[:4], None) for r in able[k:]] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(ranked + rest, key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_whole_table(table):
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    target = [r.text for r in table("benchmark").collect()]
    found = resampling.resample(table("documents"), table("benchmark"))
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert got(found) == brute(docs, target)


@pytest.mark.parametrize("longest,percent", [(1, 50), (2, 10), (3, 100)])
def test_awkward_rows(spark, docs_of, longest, percent):
    pairs = [(k, f"Word{k % 7} wÖrd x{k} the THE _the-{k}") for k in range(60)]
    pairs += [(7, pairs[7][1])] * 30 + [(8, "another text of one id")] * 3
    pairs += [(None, "no id here at all"), (None, "no id here at all"), (None, None)]
    pairs += [(100, None), (101, ""), (102, "\x00 . _"), (103, "x " * 3000), (-4, "é ü ß 1 2")]
    target = ["the word x1 is 7", None, "", "Ö é the the"]
    items = spark.createDataFrame([(t, t) for t in target], "text string, doc_id string")
    found = resampling.resample(docs_of(pairs), items, percent, min_words=3, buckets=37, longest=longest)
    assert got(found) == brute(pairs, target, percent, 3, 37, longest)


def test_empty_tables(docs_of, table):
    assert got(resampling.resample(docs_of([]), table("benchmark"))) == []
    pairs = [(k, "a b c d " * 6) for k in range(20)]
    nothing = table("benchmark").limit(0)
    assert got(resampling.resample(docs_of(pairs), nothing)) == brute(pairs, [])
    few = [(1, "only a few words")]
    assert [r.rank for r in resampling.resample(docs_of(few), nothing).collect()] == [None]


@pytest.mark.parametrize("pivots", [1, 3, 12])
def test_kth_key_with_ties(spark, pivots):
    rows = [(k % 40 if k % 9 else None, k % 5) for k in range(300)] + [(3, 2)] * 200
    scored = spark.createDataFrame(rows, "doc_id long, score long")
    order = sorted((-s, int(i is None), i or 0) for i, s in rows)
    for k in (1, 2, 150, 299, 300, 499, 500):
        assert resampling.kth_key(scored, k, pivots) == order[k - 1]
