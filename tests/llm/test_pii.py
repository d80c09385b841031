"""Bootstrapped extraction against the same rules in plain Python, and what it finds on a corpus of known answers."""

import random
from collections import Counter, defaultdict

import regex

from seqloom.llm import pii

WS = " \t\n\r\x0b\x0c"


def _holds(kind, m):
    d = regex.sub("[^0-9]", "", m)
    if kind == 1:
        return all(int(p) <= 255 for p in m.split("."))
    if kind == 2:
        return 14 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in (int(x) * (1 + i % 2) for i, x in enumerate(reversed(d)))) % 10 == 0
    return 10 <= len(d) <= 15 if kind == 3 else True


def _clean(w):
    return w.lower().strip(pii.MARKS)


def _letters(w):
    return _clean(w) if regex.search(r"\p{L}", w) else None


def _left(gap):
    end = regex.sub(r"\s+", " ", gap.rstrip(pii.OPENING)).rstrip(" ")
    one = end.rsplit(" ", 1)[-1]
    return one if regex.search(r"\p{L}", one) else " ".join(end.rsplit(" ", 2)[-2:])


def _patterns(left, right):
    return ([f"l {left}"] + ([f"b {left}|{right}"] if right is not None else [])) if left else []


def brute(texts):
    """Spans (kind, start, stop) of each text."""
    occ, base = [], []
    for row, t in enumerate(texts):
        seeds = []
        for k, p in enumerate(pii.PATTERNS.values()):
            ms = list(regex.finditer(p, t))
            seeds += [(k, m, t[ms[i - 1].end() if i else 0 : m.start()], t[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(t)]) for i, m in enumerate(ms) if _holds(k, m[0])]
        base += [(row, k, m.start(), m.end()) for k, m, _, _ in seeds]
        after = lambda n: (x := regex.match(r"\S*+\s++(\S++)", n)) and x[1] or ""
        for k, m, before, n in seeds:
            glued = not regex.search(r"(^|\s)\Z", before.rstrip(pii.MARKS_ONLY))
            occ.append((row, m.start(), m.end(), m[0], k, glued, _patterns(_clean(_left(before)), _letters(after(n)))))
        ms = list(regex.finditer(pii.CANDIDATE, t))
        for i, m in enumerate(ms):
            if any(s[1].start() < m.end() and m.start() < s[1].end() for s in seeds):
                continue
            before, n = t[ms[i - 1].end() if i else 0 : m.start()], t[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(t)]
            label = (x := regex.match(r"[^0-9@]*[=:]", m[0])) and x[0] or ""
            rest = m[0][len(label) :]
            lead = regex.match(r"[^\p{L}0-9+@]*", rest)[0]
            value = regex.sub(r"(?<![^\p{L}0-9])[^\p{L}0-9]+$", "", rest[len(lead) :])
            own = _clean(regex.sub(r"^[^\p{L}]*(?=\p{L})", "", label))
            at = m.start() + len(label) + len(lead)
            if value:
                occ.append((row, at, at + len(value), value, None, bool(own), _patterns(own or _clean(_left(before)), _letters(after(n)))))
    words = Counter()
    for t in texts:
        w = regex.split(r"\s+", t)
        for i, x in enumerate(w):
            context = _clean(x if regex.search(r"\p{L}", x) else " ".join([*w[max(i - 1, 0) : i], x]))
            r = _letters(w[i + 2]) if i + 2 < len(w) and not regex.search("[0-9@]", w[i + 1]) else None
            words.update(_patterns(context, r))
    edges, apart = defaultdict(Counter), Counter()
    for _, _, _, v, _, glued, ps in occ:
        for p in ps:
            edges[p][v] += 1
            apart[p] += glued or p.startswith("b ")
    sure = {}
    for o in occ:
        if o[4] is not None:
            sure[o[3]] = min(o[4], sure.get(o[3], 9))
    while True:
        good = {}
        for p, vs in edges.items():
            for k in range(4):
                of = [v for v in vs if sure.get(v) == k]
                unknown = sum(n for v, n in vs.items() if v not in sure)
                score = (sum(vs[v] for v in of) + pii.UNKNOWN * unknown) / max(words[p] + apart[p], vs.total()) if of else 0
                if len(of) >= pii.SUPPORT and score >= pii.CONFIDENCE:
                    good[p] = max(good.get(p, (0, -9)), (score, -k))
        new = defaultdict(lambda: (0, -9))
        for p, s in good.items():
            for v in edges[p]:
                if v not in sure:
                    new[v] = max(new[v], s)
        if not new:
            break
        sure |= {v: -s[1] for v, s in new.items()}
    inside = {o[:3]: (-max(good[p] for p in o[6] if p in good)[1], o[3]) for o in occ if o[4] is None and any(p in good for p in o[6])}
    n, met = Counter(o[3] for o in occ if o[4] is None), defaultdict(Counter)
    for k, v in inside.values():
        met[v][k] += 1
    out = {(r, k, a, z) for (r, a, z), (k, _) in inside.items()}
    for o in occ:
        if o[4] is None and o[:3] not in inside and met[o[3]].total() and met[o[3]].total() >= pii.CONFIDENCE * n[o[3]]:
            out.add((o[0], min(met[o[3]], key=lambda k: (-met[o[3]][k], k)), o[1], o[2]))
    return sorted([*out, *base])


def test_against_brute_force(spark):
    r = random.Random(9)
    w = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "of", "the", "room", "7", "12", "x9", "=", '"x"', "B2,"]) for _ in range(n))
    texts, truth = [], set()
    for i in range(40):
        texts.append(f"{w(3)} phone: +1 202 555 {1000 + i} {w(2)}")
        texts.append(f"{w(2)} phone: 555-{1000 + i}-77 then {w(3)}")
        truth.add((len(texts) - 1, 3, texts[-1].index("555-"), texts[-1].index("-77") + 3))
    for i in range(6):
        texts.append(f"{w(2)} mail=u{i}@x{i}.org; {w(1)}")
        texts.append(f"{w(2)} mail=u{i}@intern {w(1)}")
        truth.add((len(texts) - 1, 0, texts[-1].index("=u") + 1, texts[-1].index("@intern") + 7))
        texts.append(f"{w(1)} charge (4111 1111 1111 1111) twice {w(2)} at 4111-{i} noon")
        texts.append(f"see u{i}@intern or room {i} {w(4)}")
        truth.add((len(texts) - 1, 0, 4, texts[-1].index("@intern") + 7))
    texts += [w(60), "", "   ", "phone: nobody", '"' * 500 + "5", "x" * 700 + " 5 " + "y" * 700, "7" * 3000, "phone: 555 0100\nphone:\t555-9 ext"]
    rows = [(i, t, "k", "v") for i, t in enumerate(texts)] + [(999, None, "k", "v"), (0, texts[0], "k", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string, pattern string").repartition(3)
    got = {x.doc_id: x.spans for x in pii.digest(docs).collect()}
    want = defaultdict(list)
    every = brute(texts + [texts[0]])
    for row, k, a, z in sorted(every, key=lambda x: (x[0], x[2], x[1])):
        if row < len(texts):
            want[row].append(f"{pii.KINDS[k]}:{a}:{z}")
    assert {i: ",".join(want[i]) for i in range(len(texts))} == {i: got[i] for i in range(len(texts))} and got[999] == ""
    seeds = {(i, k, m.start(), m.end()) for i, t in enumerate(texts) for k, p in enumerate(pii.PATTERNS.values()) for m in regex.finditer(p, t) if _holds(k, m[0])}
    added = {x for x in every if x[0] < len(texts)} - seeds
    assert truth <= added and len(truth) >= 0.9 * len(added)  # recall 1 and precision 0.9 of what the bootstrap adds


def test_masked_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "to a@b.co", "x", "y", "z", "u")], "doc_id long, text string, _v string, _rk string, _TK string, _a string")
    assert [tuple(r) for r in pii.masked(docs).collect()] == [(1, "to <EMAIL>", "x", "y", "z", "u")]


def test_totals_of_many_patterns(spark):
    """Words are rows of compiled expressions, counted as in plain Python, and the table of hashes grows with the patterns."""
    import re

    texts = ["The fox | 12 sees, the-fox ΟΔΟΣ. now", "  ", "", "(the) fox\x0b7 sees\nİx a|b | c x@y a|b", "no more", "- - - 5", "THE fox nor sees"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    clean, want = lambda w: w.lower().strip(pii.MARKS), {}
    letter = lambda w: any(c.isalpha() for c in w)
    for t in texts:
        w = re.split(r"[ \t\n\x0b\f\r]+", t)
        for i, x in enumerate(w):
            left = clean(x if letter(x) else " ".join([*w[max(0, i - 1) : i], x]))
            names = [f"l {left}"] if left else []
            if left and i + 2 < len(w) and not re.search("[0-9@]", w[i + 1]) and letter(w[i + 2]):
                names.append(f"b {left}|{clean(w[i + 2])}")
            for n in names:
                want[n] = want.get(n, 0) + 1
    assert want["l the"] == 3 and want["b the|nor"] == 1 and want["b a|b|c"] == 1
    patterns = spark.createDataFrame([(p,) for p in want], "pattern string")
    got = pii._totals(rows, patterns)
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.pattern: r.total for r in got.collect()} == want
    many = pii._marked(spark.range(40_000).selectExpr("concat('l w', id) as pattern"))
    assert sum(many) < len(many) / 7
