"""The model against a plain one."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np

from reelgrid.llm import kneser_ney


def _plain(texts: list[str], order: int):
    """Interpolated modified Kneser-Ney over symbols, as a function of (history, symbol)."""
    grams = Counter()
    for t in texts:
        x = [1] * (order - 1) + [int(kneser_ney.ALPHABET[b]) for b in t.encode()]
        grams.update(tuple(x[i : i + order]) for i in range(len(x) - order + 1))
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount = {}
    for n, counts in levels.items():
        of = Counter(counts.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        discount[n] = [min(k * 0.95, max(0.05 * k, k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5 * k)) for k in (1, 2, 3)]
    after = {n: defaultdict(list) for n in levels}
    for n, counts in levels.items():
        for g, c in counts.items():
            after[n][g[:-1]].append(c)

    def p(gram: tuple) -> float:
        n = len(gram)
        if n == 0:
            return 1 / kneser_ney.SYMBOLS
        seen = after[n].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        d, total, c = discount[n], sum(seen), levels[n][gram]
        left = sum(d[min(x, 3) - 1] for x in seen) / total
        return (c - d[min(c, 3) - 1] if c else 0) / total + left * p(gram[1:])

    return p


def test_probabilities_are_those_of_a_plain_model(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabcd e.") for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    names, model = kneser_ney.train(spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(3), 3)
    table = 2.0 ** -kneser_ney.log_table(model, len(names), 3).astype(float)[names.index("en")]
    p, s = _plain(texts, 3), kneser_ney.SYMBOLS
    symbols = sorted({int(kneser_ney.ALPHABET[b]) for b in b"abcd e.Z9\n"})
    for g in ((a, b, c) for a in symbols for b in symbols for c in symbols):
        assert np.isclose(table[g[0] * s * s + g[1] * s + g[2]], p(g), rtol=1e-4)
