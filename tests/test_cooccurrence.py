"""Co-occurrence anchors against brute force over all word pairs."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import anchors as A


def test_pairs_that_are_left_out_change_no_anchor(spark):
    rng = np.random.default_rng(0)
    lines = []
    for i in range(300):
        s = [f"s{int(x)}" for x in rng.zipf(1.3, 6) % 90] + ["all"]
        t = [] if i % 17 == 0 else [f"t{int(x)}" for x in rng.zipf(1.3, 8) % 90] + ["every"] * (i % 2)
        lines.append((i // 2, s, t))  # two rows may have the same line number
    df = spark.createDataFrame(lines, "line_no long, s array<string>, t array<string>").repartition(3)
    seen, n, first = Counter(), Counter(), {}
    for line, s, t in lines:
        for x in set(s) if t else ():
            seen[x] += 1
            for y in set(t):
                n[x, y] += 1
                first[x, y] = min(first.get((x, y), line), line)
    by = defaultdict(list)
    for (x, y), k in n.items():
        by[x].append((-k, first[x, y], y))
    for least, share in ((3, 0.3), (1, 0.0), (5, 0.6), (2, 0.5)):
        want = {(x, min(by[x])[2], -min(by[x])[0] / seen[x], seen[x]) for x in by if seen[x] >= least and -min(by[x])[0] / seen[x] >= share}
        got = A.cooccurrence_anchors(df, F.col("s"), F.col("t"), least=least, least_share=share)
        # words are dealt out as lists and paired only then
        plan = got._jdf.queryExecution().analyzed().toString()
        assert plan.index("Generate explode(t") < plan.index("RepartitionByExpression [surface")
        assert {tuple(r) for r in got.collect()} == want and want
