"""The whole pipeline on a small corpus against its rules in plain Python."""

import re
from collections import Counter, defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from seqloom.llm import language, packing

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_pipeline_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    base = docs.orderBy("doc_id").collect()
    clean = next(r for r in base if r.lang == "en" and len(r.text.split()) > 120 and "@" not in r.text)
    words = clean.text.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    own, other = " ".join(reversed(words)), " ".join(words[::2] + words[1::2])
    long_item = max(items, key=len)
    extra = [(10**6, near, "en", "s", 0), (10**6 + 1, "123 456 ...", None, "s", 0), (10**6 + 2, None, None, None, 0), (10**6 + 3, f"{own} {long_item}", "en", None, 0), (10**6 + 4, f"{other} mail a.b@c-d.org now", "en", "t", 0)]
    whole = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("n_chars", docs["n_chars"] * 0)
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    rows = {r.doc_id: r.text for r in whole.collect()}
    said = {r.doc_id: r for r in language.digest(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    left = {i: t for i, t in rows.items() if said[i].lang_pred != "und" and said[i].score >= 0.5}
    cut = lambda t, rule: re.findall(rule, t.translate(LOW))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := cut(t, r"[^\x20\x09-\x0D]+")) else set() for i, t in left.items()}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_gram = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by_gram[g].append(i)
    shared = Counter((a, b) for v in by_gram.values() for k, a in enumerate(v) for b in v[:k])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    left = {i: t for i, t in left.items() if find(i) == i}
    rule = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {tuple(w[k : k + 10]) for t in items for w in [cut(t, rule)] for k in range(max(len(w) - 10, 0) + 1 if w else 0)}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    left = {i: t for i, t in left.items() if not hit(cut(t, rule))}
    assert {r.doc_id for r in got} == set(left) and clean.doc_id in left and not {10**6 + k for k in range(4)} & set(left)

    tok = Tokenizer.from_file(packing.PATH)
    tok.encode_special_tokens = True
    size = {r.doc_id: r.doc_tokens for r in got}
    plain = [i for i, t in left.items() if not re.search("[0-9@]", t)]
    assert plain and all(size[i] == len(tok.encode(left[i], add_special_tokens=False).ids) + 1 for i in plain)
    masked = left[10**6 + 4].replace("a.b@c-d.org", "<EMAIL>")
    assert size[10**6 + 4] == len(tok.encode(masked, add_special_tokens=False).ids) + 1
    places = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places[r.sequence_id]
        places[r.sequence_id] += r.length
    assert sorted(places.values())[1:] == [1024] * (len(places) - 1) and sum(places.values()) == sum(size.values())
