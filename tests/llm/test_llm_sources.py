"""Mixing targets of many sources."""

from __future__ import annotations

import random
import re

from quizgrove.llm import mixing
from tests.llm import brute


def test_many_sources_are_not_ordered_in_one_task(spark, monkeypatch):
    generator = random.Random(9)
    sizes = {f"s{i}" if i else None: generator.choice([0, 1, 7, 7, 40, generator.randrange(1, 5000)]) for i in range(3000)}
    plans, save = [], mixing.saved

    def noted(df, label):
        plans.append(df._jdf.queryExecution().toString())
        return save(df, label)

    monkeypatch.setattr(mixing, "saved", noted)
    sources = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, docs long")
    found = mixing.source_targets(sources)
    plans.append(found._jdf.queryExecution().toString())
    assert {r["source"]: r["target"] for r in found.collect()} == brute.targets(sizes)
    assert not [x for plan in plans for x in re.findall(r"windowspecdefinition\(([a-z_]+)", plan) if x != "range"]
    assert mixing.source_targets(sources.limit(0)).collect() == []
