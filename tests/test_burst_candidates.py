"""A long train is searched whole: no burst candidate is left out unless that is asked for."""

from itertools import accumulate

from pyspark.sql import functions as F

from pulsegrid.functions.grammar import Grammar
from pulsegrid.operators import detectors as de
from pulsegrid.sources.csv import golden

# a seed run with four bridges on each side: 25 candidates
ONE = [0.2, 0.012, 0.013, 0.012, 0.013, 0.005, 0.005, 0.005, 0.013, 0.012, 0.013, 0.012]


def test_candidates_past_the_3000th(spark):
    rows = de.usable(golden(spark, {"long": [0, *accumulate(ONE * 130 + [0.2])]}).withColumn("manual", F.lit("")), Grammar())
    count = lambda g: de.bursts(rows, de.references(rows, g), g).where("layer = 'burst'").agg(F.count("*"), F.max("start")).first()
    n, last = count(Grammar())
    assert n == 25 * 130 and last > 129 * len(ONE)
    assert count(Grammar(max_candidates=3000))[0] == 3000
