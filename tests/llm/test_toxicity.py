import math
import random
import re
import zlib

import numpy as np

from matchloom.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(1)
    terms = {"idiot": 1.0, "worthless": 1.0, "disgusting": 1.0, "scum": 1.0, "lowe*": 1.0}
    auto = toxicity.Automaton(terms)
    words = {"".join(rng.choice(list("abcdeginostuw"), rng.integers(1, 12))) for _ in range(500)}
    for t in ("idiot", "worthless", "disgusting", "scum"):
        for _ in range(300):
            w = list(t)
            for _ in range(rng.integers(0, 4)):
                k = rng.integers(0, len(w) + 1)
                w[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("iodestx"), rng.integers(0, 2)))
            words.add("".join(w))
    words |= {"lowest", "lowe", "loweichen", "low", "xlowe"}
    for w in words:
        if w.startswith("lowe"):
            assert auto.match(w) == ("lowe*", 0)
            continue
        near = [(distance(w, t), t) for t in terms if not t.endswith("*") and distance(w, t) <= auto.errors(t)]
        got = auto.match(w)
        assert (got and got[1]) == (min(near)[0] if near else None), w


def test_quotation_is_told_apart():
    auto = toxicity.Automaton({"idiot": 2.0})
    plain, quoted = (toxicity.features(t, auto, {}) for t in ("you idiot, idiot", 'he said "idiot" and «idiot» there'))
    assert plain[0] > 0 and plain[4] > 0 and plain[3] == 0
    assert quoted[0] == 0 and quoted[3] > 0


def test_quoted_terms_are_no_abuse():
    auto = toxicity.Automaton({"idiot": 2.0, "moron": 2.0})
    got = toxicity.features('she said "idiot" to them, and «moron»', auto, {})
    assert got[3] > 0 and [x for i, x in enumerate(got) if i != 3] == [0.0] * 5


def test_quotations_of_any_length_are_paired_over_the_line():
    auto = toxicity.Automaton({"idiot": 2.0})
    filler = "word " * 60
    inside, outside = f'"{filler} idiot {filler}"', f'"{filler}" You idiot, he said "no"'
    assert toxicity.features(inside, auto, {})[0] == 0 and toxicity.features(inside, auto, {})[3] > 0
    assert toxicity.features(outside, auto, {})[0] > 0 and toxicity.features(outside, auto, {})[3] == 0
    assert toxicity.quotations('a "b" c\n" d «e» „f“ "g') == [(2, 4), (8, 20)] and toxicity.quotations("none") == []
    assert toxicity.features('"\nidiot"', auto, {})[0] > 0


def test_disguised_words_reach_the_automaton():
    auto = toxicity.Automaton({"idiot": 2.0, "worthless": 2.0, "disgusting": 2.0})
    for word in ("id1ot", "idi0t", "id!ot", "i*diot", "w0rthless", "worth|ess", "d1sgust1ng", "di$gu$ting"):
        assert toxicity.features(f"you {word}.", auto, {})[1] > 0, word
    assert not any(toxicity.features("a@b.c 12 345 $ !! **", auto, {}))


def brute(rows, labels):
    """The whole method by plain loops: what the query must say of each (doc_id, text)."""
    word, held = re.compile(r"[$@]?[^\W_]+(?:[$@!|*]+[^\W_]+)*"), lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    fit = [(t or "", labels[i]) for i, t in sorted(rows) if i in labels and not held(i)]
    families = [({w for w in word.findall(t.lower())}, y) for t, y in fit]
    families = [(s | {w[:n] + "*" for w in s for n in (4, 5, 6, 7) if len(w) > n}, y) for s, y in families]
    toxic, other = sum(y for _, y in fit), sum(1 - y for _, y in fit)
    every = set().union(*(s for s, _ in families))
    lexicon = {}
    for term in every:
        k, o = sum(term in s for s, y in families if y), sum(term in s for s, y in families if not y)
        if k < 4 or k / toxic <= 5 * o / other:
            continue
        ll = lambda k, n, q: (k * math.log(q) if k else 0) + ((n - k) * math.log(1 - q) if n > k else 0)
        p = (k + o) / (toxic + other)
        if 2 * (ll(k, toxic, k / toxic) + ll(o, other, o / other) - ll(k, toxic, p) - ll(o, other, p)) >= 2 * math.log(len(every)) + 2:
            lexicon[term] = math.log((k + 0.5) / (toxic + 1)) - math.log((o + 0.5) / (other + 1))
    stems = sorted((x for x in lexicon if x.endswith("*")), key=len)

    def match(w):
        for s in stems:
            if w.startswith(s[:-1]):
                return s, 0
        near = []
        for term in lexicon:
            if not term.endswith("*") and not any(term.startswith(s[:-1]) for s in stems):
                d = distance(w, term)
                if d <= (2 if len(term) >= 10 else int(len(term) >= 5)):
                    near.append((d, term))
        return min(near)[::-1] if near else None

    def features(text):
        text = text.lower()
        found = [(i, m, match(m[0])) for i, m in enumerate(word.finditer(text))]
        plain, quoted = [], 0
        for i, m, hit in found:
            if hit:
                line, rest = text[: m.start()].rsplit("\n", 1)[-1], text[m.end() :].split("\n", 1)[0]
                if line.count('"') % 2 and '"' in rest:
                    quoted += 1
                else:
                    plain.append((i, *hit))
        exact = [t for _, t, e in plain if not e]
        crowded = sum(b - a <= 8 for (a, *_), (b, *_) in zip(plain, plain[1:]))
        weight = max((lexicon[t] * 0.5**e for _, t, e in plain), default=0.0)
        return [math.log1p(len(exact)), math.log1p(len(plain) - len(exact)), weight, math.log1p(quoted), math.log1p(crowded), math.log1p(len(set(exact)))]

    X, y = np.array([[*features(t), 1.0] for t, _ in fit]), np.array([v for _, v in fit], float)
    theta = np.zeros(7)
    for _ in range(20_000):  # plain gradient steps on the same convex loss
        theta -= 0.08 * (X.T @ (1 / (1 + np.exp(-X @ theta)) - y) / len(y) + 1e-3 * theta)
    return lexicon, {i: 1 / (1 + math.exp(-(np.array([*features(t or ""), 1.0]) @ theta))) for i, t in rows}


def test_query_equals_brute_force(spark):
    rng = random.Random(8)
    plain, bad = [f"{a}{b}" for a in "bdfglm" for b in ("ar", "onet", "uvil", "ysh")], ["idiot", "worthless", "disgusting", "scum"]
    rows, labels = [], {}
    for i in range(160):
        words = [rng.choice(plain) + str(rng.randrange(9)) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(rng.randint(2, 6)):
                w = rng.choice(bad)
                words.insert(rng.randrange(len(words)), w if rng.random() < 0.7 else w.replace("i", "1"))
        elif i % 4 == 1 and i % 3:
            words.insert(9, f'"{rng.choice(bad)}"')
        rows.append((i, " ".join(words)))
        labels[i] = int(i % 4 == 0)
    rows += [(900, None), (901, ""), (902, "worthles scum"), (903, "nothing")]
    lexicon, want = brute(rows, labels)
    assert lexicon and len(set(map(toxicity.sketch, dict(rows[:160]).values()))) == 160
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([(i, None, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marked)
    assert model.lexicon.keys() == lexicon.keys() and all(abs(model.lexicon[t] - w) < 1e-9 for t, w in lexicon.items())
    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - want[r.doc_id]) < 2e-3, (r, want[r.doc_id])


def test_rare_terms_of_one_document_are_not_learned():
    got = toxicity.choose_terms([("bad", 60, 0), ("the", 90, 900), ("once", 3, 0)], 100, 900, 100_000)
    assert set(got) == {"bad"}


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in got if r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.8
    assert sum(r.predicted for r in got if not r.toxic) / (len(got) - len(toxic)) < 0.02


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(odd_docs, none) is None
    assert {r.score for r in toxicity.score(odd_docs, None).collect()} == {0.0}
    model = toxicity.Model({"alpha": 3.0}, np.array([1.0, 0, 1.0, 0, 0, 0, -3.0]))
    got = {r.doc_id: r.score for r in toxicity.score(odd_docs, model).collect()}
    assert got[100] == got[101] < 0.1 and toxicity.score(odd_docs, model).count() == odd_docs.count()
    assert toxicity.score(no_docs, model).count() == 0
