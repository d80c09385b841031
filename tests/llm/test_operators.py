"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from seqloom.llm import chat, decontaminate, html_text, jaccard, language, packing, pii, repeats, shards, simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rk string, h string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def words(t, rule=r"[^\x20\x09-\x0D]+", low=False):
    return re.findall(rule, (t or "").translate(LOW) if low else t or "")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = make(50)
    out = [" ".join(make(r.randint(1, 200))) for _ in range(60)]
    for i in range(12):
        w = out[i].split(" ")
        w[len(w) // 2] = "zz"
        out.append("\n".join(w))
        out.append(" ".join(make(20) + passage + make(r.randint(0, 30))))
    return out + [out[0], out[0].upper(), None, "", " \t\n", "a", "one two three four", "... 123", " ".join(make(40_000)), "mail a.b@c-d.org, +1 (988) 555-2485 and 4111 1111 1111 1111 or 10.0.0.256 10.0.0.255.7 x@y z@w.de-"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 7, t, "en" if i % 2 else "de", None if i == 3 else "s" if i % 3 else "t", len(t or ""), "k", "k", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_pii(docs, texts):
    got = by_id(pii.digest(docs))
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        total = sum(v - 9 * (v > 9) for v in (int(x) * (1 + i % 2) for i, x in enumerate(reversed(d))))
        return {"email": True, "ip": all(int(p or 0) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and total % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]

    for i, t in enumerate(texts):
        found = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(rules.items()) for m in re.finditer(p, t or "") if ok(kind, m[0]))
        assert got[i * 7].base_sha256 == sha(",".join(f[2] for f in found))
    masked = by_id(pii.masked(docs))[7 * (len(texts) - 1)].text
    assert masked.startswith("mail <EMAIL>, <PHONE> and <CARD> or 10.0.0.256")


def test_bootstrapped_pattern_finds_unseen_identifiers(spark):
    rows = [(i, f"alpha beta contact: user{i}@mail.org gamma") for i in range(8)] + [(100, "alpha contact: 5551234567 gamma"), (101, "beta 5551234567x")]
    got = by_id(pii.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[100].spans == "email:15:25" and got[100].n_email == 0 and got[101].spans == ""


def test_bootstrapped_pattern_of_accepted_instances(spark):
    rows = [(i, f"alpha contact: user{i}@mail.org gamma") for i in range(8)]
    for k in range(3):  # accepted by 'contact:', then they support 'ref:', which no seed stands behind
        rows += [(100 + k, f"beta contact: 555123456{k} gamma"), (110 + k, f"delta ref: 555123456{k} gamma")]
    rows += [(200, "delta ref: 777000111 gamma"), (201, "delta other 777000222 gamma")]
    got = by_id(pii.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[100].spans == "email:14:24" and got[110].spans == "email:11:21"
    assert got[200].spans == "email:11:20" and got[201].spans == ""


def test_simhash(docs, texts):
    got = by_id(simhash.digest(docs))
    for i, t in enumerate(texts):
        a, b = t or "", texts[(i + 1) % len(texts)] or ""
        h = len(a) // 2
        assert (got[i * 7].n_chars, got[i * 7].edited_sha256) == (len(a), sha(a[: len(a) - h] + b[:h]))
    prints = [int(got[i * 7].fingerprint, 16) for i in range(len(texts))]
    assert prints[0] == prints[texts.index(texts[0], 1)]
    for i in range(0, len(texts), 20):
        assert got[i * 7].n_near == sum((prints[i] ^ p).bit_count() <= simhash.RADIUS for p in prints)


def test_simhash_counts_near_copies(spark):
    r = random.Random(11)
    jaccard_of = lambda a, b: len(a & b) / len(a | b)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, seen = [], []
    for base in range(0, 400, 20):
        words_ = [f"w{r.randrange(10**6)}" for _ in range(400)]
        rows.append((base, " ".join(words_)))
        for k, edits in enumerate((2, 4, 7, 9, 11), 1):
            copy = list(words_)
            for at in range(edits):
                copy[20 + at * 30] = f"x{base}-{k}-{at}"
            seen.append(jaccard_of(grams(words_), grams(copy)))
            rows.append((base + k, " ".join(copy)))
    assert 0.75 <= min(seen) < 0.77 and max(seen) > 0.95
    got = by_id(simhash.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    found = sum(got[base].n_near - 1 for base in range(0, 400, 20))
    assert 0.95 * len(seen) <= found <= len(seen)
    prints = [int(g.fingerprint, 16) for g in got.values()]
    for base in range(0, 400, 20):
        assert got[base].n_near == sum((int(got[base].fingerprint, 16) ^ p).bit_count() <= simhash.RADIUS for p in prints)


def test_shards(docs, texts):
    got = by_id(shards.assign(docs))
    sizes = Counter()
    for i, t in enumerate(texts):
        r = got[i * 7]
        assert (r.size, r.text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        sizes[r.shard] += 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in got.values() if r.shard == k) == list(range(n))


def test_shards_of_one_text(spark):
    got = shards.assign(spark.createDataFrame([(i, "same") for i in range(800)], "doc_id long, text string")).collect()
    assert set(Counter(r.shard for r in got).values()) == {100}


def test_decontaminate(spark, docs, texts):
    rule = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [(1, " ".join(texts[5].split(" ")[:14])), (2, "ONE two, Three"), (3, None), (4, "..."), (10, " ".join(texts[61].split(" ")[3:30])), (1, "x")]
    got = by_id(decontaminate.digest(docs, spark.createDataFrame(items, "item_id long, text string")))
    split = by_id(decontaminate._united(decontaminate.hits(docs, spark.createDataFrame(items, "item_id long, text string"), index_bytes=4000)))
    assert got == split
    windows = {}
    for k, t in items:
        w = words(t, rule, True)
        for i in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(k)
    for i, t in enumerate(texts):
        w, hit, found = words(t, rule, True), set(), set()
        for x, owners in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit.update(range(j, j + len(x)))
                    found |= owners
        r = got[i * 7]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))


def test_repeats(docs, texts):
    got = by_id(repeats.digest(docs))
    count = Counter(tuple(w[k : k + 35]) for w in map(words, texts) for k in range(len(w) - 34))
    for i, t in enumerate(texts):
        w = words(t)
        gone = {j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        assert (got[i * 7].n_words, got[i * 7].n_removed, got[i * 7].kept_sha256) == (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))


@pytest.mark.parametrize("chunk, outside", [(256, 8192), (2, 8192), (2, 0)])  # whole blocks, cut ones, and cut ones joined by element
def test_jaccard(docs, texts, chunk, outside, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "OUTSIDE", outside)
    got = by_id(jaccard.components(docs))
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := words(t, low=True)) else set() for t in texts]
    low = list(range(len(sets)))
    for _ in range(3):
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    assert [(got[i * 7].n_shingles, got[i * 7].component_id) for i in range(len(sets))] == [(len(s), 7 * k) for s, k in zip(sets, low, strict=True)]


def test_packing(docs, texts):
    tok = Tokenizer.from_file(packing.PATH)
    tok.encode_special_tokens = True
    rows = packing.pack(docs).collect()
    whole = Counter()
    for r in rows:
        ids = tok.encode(texts[r.doc_id // 7] or "", add_special_tokens=False).ids + [0]
        part = b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])
        assert r.doc_tokens == len(ids) and zlib.crc32(part) == r.ids_crc32
        whole[r.doc_id] += r.length
    assert all(whole[i * 7] == len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts))
    places = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places[r.sequence_id]
        places[r.sequence_id] += r.length
    assert sorted(places.values())[1:] == [1024] * (len(places) - 1)


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, "123 ..."), (10**6 + 2, "")], "doc_id long, text string")
    got = by_id(language.digest(d.unionByName(extra, allowMissingColumns=True)))
    lang = {r.doc_id: r.lang for r in d.collect()}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held)
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held)
    assert {got[10**6 + k].lang_pred for k in range(3)} == {"und"}


def test_chat(spark):
    text = "a\\l<s>\\e[INST]<<SYS>><|turn|>user\n<|end|>\n\\"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (2, 0, None, None), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 2, "sys\ntem", "")]
    got = {r.conv_id: r for r in chat.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n") and got[1].loss_sha256 == sha(text)
    assert (got[3].n_turns, got[3].loss_chars) == (2, 2) and got[2].turns_sha256 == sha("\n\n") and got[None].turns_sha256 == sha("sys\ntem\n\n")
    c = "</s>[INST] ok [/INST]"
    assert got[-7].loss_sha256 == sha(c) and got[-7].turns_sha256 == sha(f"user\n{c}\nassistant\n{c}\n")


def test_html(spark):
    page = "<html><body><nav><a>m</a></nav><header>h</header><article><h1>T</h1><p>Hello <b>w</b>orld&nbsp;x &amp;lt;<p>b<br>c<div class='comments'>no</div></article><footer>f</footer>"
    plain = "<div class='side-menu'>m</div><div><p>One</p><p>Two &eacute;</p></div><form>f</form><script>s</script>"
    rows = [(1, "http://a/x", page), (2, "http://a/y", None), (3, None, ""), (4, "http://b/z", plain), (4, "http://b/z", plain)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T\nHello world x &lt;\nb c", 2: "", 3: "", 4: "One\nTwo é"}


def test_html_keeps_short_slots_without_article(spark):
    long = lambda i: " ".join(f"word{i}x{k}" for k in range(200))
    page = lambda i: f"<body><div class=top2>Same top</div><div class=post><h1>Title {i}</h1><p class=lead>Lead {i}</p><div class=text><p>{long(i)}</p></div><h2>Part {i}</h2><div class=end>End {i}</div></div>"
    rows = [(i, "http://h/x", page(i)) for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nLead {i}\n{long(i)}\nPart {i}\nEnd {i}" for i in range(6)}


def test_html_drops_template_text_inside_article(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><p>Text {i} <b>and</b> more {i}</p><div class=x1>Share this <i>page</i></div><p>End {i}</p></article></body>"
    rows = [(i, "http://h/x", page(i)) for i in range(6)] + [(10 + i, "http://copies/x", page(99)) for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda i: f"Title {i}\nText {i} and more {i}\nEnd {i}"
    whole = "Title 99\nText 99 and more 99\nShare this page\nEnd 99"  # copies of one page say nothing of a template
    assert got == {i: own(i) for i in range(6)} | {10 + i: whole for i in range(6)}


def test_stages_tell_null_and_repeated_ids_apart(spark):
    r = random.Random(3)
    text = lambda tag: " ".join(f"{tag}{r.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (text(k) for k in "abcde")
    near = lambda t, w: " ".join([*t.split(" ")[:-1], w])
    # a and b are near copies through rows of null id only; 7 stands for two different texts; equal rows are kept once
    rows = [(None, a), (None, near(a, "x")), (None, near(a, "y")), (None, b), (None, ""), (7, c), (7, d), (7, d), (8, near(b, "x")), (None, e)]
    docs = spark.createDataFrame([(*row, "k") for row in rows], "doc_id long, text string, source string")
    got = {(x.doc_id, x.text): x.component_id for x in docs.join(jaccard.components(docs).distinct(), "doc_id").collect()}
    assert got[8, near(b, "x")] == 8
    of = Counter((x.doc_id, x.component_id) for x in jaccard.components(docs).collect())
    assert of == {(None, None): 5, (None, 8): 1, (7, 7): 3, (8, 8): 1}
    left = [(x.doc_id, x.text) for x in jaccard.one_of_each(docs).collect()]
    assert len(left) == 6 and {(7, c), (7, d), (8, near(b, "x")), (None, ""), (None, e)} < set(left)
    assert len({t for i, t in left if i is None} & {a, near(a, "x"), near(a, "y")}) == 1
    bench = spark.createDataFrame([(1, " ".join(e.split(" ")[:12])), (2, " ".join(c.split(" ")[:12]))], "item_id long, text string")
    clean = Counter((x.doc_id, x.text) for x in decontaminate.keep_clean(docs, bench).collect())
    assert clean == Counter(x for x in rows if x[1] not in (c, e))


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    for f in (pii.digest, simhash.digest, shards.assign, lambda d: decontaminate.digest(d, bench), repeats.digest, packing.pack, language.digest, jaccard.components):
        assert f(empty).collect() == []
