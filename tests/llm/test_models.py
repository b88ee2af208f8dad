"""The models of toxicity and of languages against plain versions with dictionaries."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from quaylark.llm import language_id, toxicity


def plain_discount(values):
    once, twice = sum(v == 1 for v in values), sum(v == 2 for v in values)
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def plain_telling(a, b, total_a, total_b):
    """Enough counts, and a clear difference between the classes."""
    both, size = a + b, (max(total_a, 1e-9), max(total_b, 1e-9))
    expected = [n / sum(size) * both for n in size]
    g2 = 2 * sum(c * math.log(max(c, 1e-9) / max(e, 1e-9)) for c, e in zip((a, b), expected, strict=True))
    ratio = [math.log((c + 0.5) / (e + 0.5)) for c, e in zip((a, b), expected, strict=True)]
    return both >= toxicity.RARE and g2 >= toxicity.LEAST_G2 and abs(ratio[0] - ratio[1]) >= toxicity.LEAST_RATIO


def plain_level(counts, group, below):
    """Interpolated shares of both classes: {key: (p0, p1)} from {key: (c0, c1)}, keys falling into groups."""
    d = plain_discount([a + b for a, b in counts.values() if a + b])
    totals = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    clear = {x: plain_telling(*c, *totals) for x, c in counts.items()}
    seen, sure, mass = Counter(), Counter(), (Counter(), Counter())
    for x, c in counts.items():
        seen[group(x)] += sum(c)
        if clear[x]:
            sure[group(x)] += sum(c) - d
            for k in (0, 1):
                mass[k][group(x)] += max(c[k] - d, 0)
    out = {}
    for x, c in counts.items():
        g = group(x)
        back = 1 - sure[g] / max(seen[g], 1)
        out[x] = tuple((1 - back) * (max(c[k] - d, 0) if clear[x] else 0) / max(mass[k][g], 1e-9) + back * below(x, k) for k in (0, 1))
    return out, clear


def test_kneser_ney_is_the_plain_model():
    rng = np.random.default_rng(4)
    n_words = 40
    stem = np.concatenate(([0], 1 + np.arange(n_words) // 2))
    texts = []
    for toxic in (True, False):  # some words are far more frequent in one class
        weight = np.where((np.arange(1, n_words + 1) < 8) == toxic, 8.0, 1.0)
        texts.append([rng.choice(np.arange(1, n_words + 1), size=rng.integers(3, 30), p=weight / weight.sum()) for _ in range(60)])
    flat = [(np.concatenate(t).astype(np.int64), np.array([len(x) for x in t])) for t in texts]
    pairs = [toxicity.contexts_of(*f) for f in flat]
    model = toxicity.KneserNeyPair(pairs, stem)

    found = [set() for _ in texts]  # (word before that, word before, word)
    for k, t in enumerate(texts):
        for x in t:
            padded = [0, *x.tolist()]
            for i in range(1, len(padded)):
                found[k].add((padded[i - 2] if i >= 2 else 0, padded[i - 1], padded[i]))
    counts = {p: tuple(sum(1 for f in found[k] if f[1:] == p) for k in (0, 1)) for p in {f[1:] for s in found for f in s}}
    ends = {w: tuple(len({v for v, x in counts if x == w and counts[v, x][k]}) for k in (0, 1)) for w in range(n_words + 1)}
    few = {w: min(sum(c), toxicity.RARE) for w, c in ends.items()}
    shared = {w: n / max(1, sum(few.values())) * (1 - 1e-3) + 1e-3 / len(ends) for w, n in few.items()}
    members = defaultdict(list)
    for w, s in enumerate(stem.tolist()):
        members[s].append(w)
    stems = {s: tuple(sum(ends[w][k] for w in ws) for k in (0, 1)) for s, ws in members.items()}
    few_stems = {s: min(sum(c), toxicity.RARE) for s, c in stems.items()}
    under = {s: n / max(1, sum(few_stems.values())) * (1 - 1e-3) + 1e-3 / len(stems) for s, n in few_stems.items()}
    by_stem, _ = plain_level(stems, lambda s: 0, lambda s, k: under[s])
    low, _ = plain_level(ends, lambda w: 0, lambda w, k: by_stem[int(stem[w])][k] * shared[w] / sum(shared[x] for x in members[int(stem[w])]))
    high, clear = plain_level(counts, lambda p: p[0], lambda p, k: low[p[1]][k])
    log = lambda p: math.log(p[0]) - math.log(p[1])
    assert any(clear.values())
    for x in (*texts[0][:20], *texts[1][:20]):
        said = {(v, w) for v, w in zip([0, *x.tolist()[:-1]], x.tolist(), strict=True)}
        want = sum(log(high[p]) if clear[p] else log(low[p[1]]) for p in said) / math.sqrt(len(said))
        assert model.evidence(x.astype(np.int64), np.array([len(x)]))[0] == pytest.approx(want, abs=1e-4)


def test_languages_are_the_plain_model(spark, sf_dir):
    """Posteriors by dictionaries: smoothed bigrams, the declared language and the host's smoothed prior."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("declared", F.when(F.col("doc_id") % 4 == 0, "fr").when(F.col("doc_id") % 4 == 1, "xx"))
    model = language_id.fit(docs)
    rows = docs.collect()
    grams = lambda t: [a + b for a, b in zip(*(lambda x: ([bytes([c]) for c in x[:-1]], [bytes([c]) for c in x[1:]]))(b" ".join(t.lower().split())), strict=True)]
    langs = sorted({r["lang"] for r in rows})
    assert model.langs == langs
    sizes = Counter(r["lang"] for r in rows)
    share = language_id.MOST_DOCS // len(langs)
    assert max(sizes.values()) <= share  # every row is in the sample
    counts, before = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for r in rows:
        g = grams((r["text"] or "").encode())
        counts[r["lang"]].update(g)
        before[r["lang"]].update(x[:1] for x in g)

    def fuse(r, prior):
        g = grams((r["text"] or "").encode())
        weight = min(1.0, language_id.EFFECTIVE / max(len(g), 1))
        logs = []
        total = {x: sum(math.log((counts[x][b] + 0.02) / (before[x][b[:1]] + 256 * 0.02)) for b in g) for x in langs}
        for x in langs:
            said = 0.0
            if r["declared"] in langs:
                said = math.log(language_id.DECLARED if r["declared"] == x else (1 - language_id.DECLARED) / (len(langs) - 1))
            logs.append(total[x] * weight + said + math.log(prior[x]))
        p = np.exp(np.array(logs) - max(logs))
        return dict(zip(langs, p / p.sum(), strict=True)), bool(g) and max(total.values()) / len(g) >= model.floor

    alone, hosts = Counter(), defaultdict(Counter)
    for r in rows:
        p, fits = fuse(r, dict.fromkeys(langs, 1 / len(langs)))
        if fits:
            best = max(langs, key=lambda x: p[x])
            alone[best] += 1
            hosts[r["source"]][best] += 1
    world = {x: (alone[x] + 1) / (sum(alone.values()) + len(langs)) for x in langs}
    pull = lambda c, up: {x: (c[x] + language_id.STRENGTH * up[x]) / (sum(c.values()) + language_id.STRENGTH) for x in langs}
    suffix = defaultdict(Counter)
    for h, c in hosts.items():
        suffix[h.rsplit(".", 1)[1] if "." in h else ""].update(c)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model, host=F.col("source"), markup=F.col("declared")).collect()}
    for r in rows:
        s = r["source"].rsplit(".", 1)[1] if "." in r["source"] else ""
        prior = pull(hosts[r["source"]], pull(suffix[s], world)) if r["source"] in hosts else dict.fromkeys(langs, 1 / len(langs))
        p, fits = fuse(r, prior)
        best = max(langs, key=lambda x: p[x])
        assert got[r["doc_id"]]["fits"] == fits and got[r["doc_id"]]["posterior"] == pytest.approx(p[best], abs=1e-4)
        assert got[r["doc_id"]]["language"] == (best if fits else "und")
