"""Semi-Markov decoding of stays that are far longer than expected."""

import itertools
import math

import numpy as np

from pulsegrid.operators import models as mo


def decoded(spark, isi, *settings):
    df = spark.createDataFrame([(1, i + 2, float(v), True) for i, v in enumerate(isi)], "train long, idx long, isi double, valid boolean")
    return [r.state for r in mo.semi_markov(df, *settings).orderBy("idx").collect()]


def test_a_long_stay_is_not_cut(spark):
    isi = [0.01] * 10 + [0.1] * 400 + [0.01] * 90
    assert decoded(spark, isi, [-2.0, -1.0], 0.3, [8.0, 5.0]) == [0] * 10 + [1] * 400 + [0] * 90


def test_likeliest_of_all(spark):
    means, sd, stay = [-2.2, -1.5, -1.0], 0.35, [4.0, 8.0, 3.0]
    x = np.random.default_rng(2).normal(-1.6, 0.5, 8)

    def score(states):
        total = sum(-0.5 * ((v - means[s]) / sd) ** 2 for v, s in zip(x, states, strict=True))
        stays = [(s, len([*g])) for s, g in itertools.groupby(states)]
        return total + sum((d - 1) * math.log(1 - 1 / stay[s]) + math.log(1 / stay[s]) for s, d in stays) + (len(stays) - 1) * math.log(1 / 2)

    assert decoded(spark, 10**x, means, sd, stay) == list(max(itertools.product(range(3), repeat=8), key=score))
