import random

import pytest
from pyspark.sql import functions as F

from fieldspan.operators import expansion as x
from fieldspan.operators import robustness as r
from fieldspan.operators.expansion import class_pairs, citation_links

K = "family_id"


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def graph(spark, n=400, seed=1):
    """A random corpus in the nested layout: dates, codes (with repeats), citations (with gaps)."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        date = rnd.choice([0, 20000000]) if rnd.random() < 0.05 else rnd.randint(1990, 2010) * 10000 + rnd.randint(101, 1231)
        codes = [(f"C{min(rnd.randint(0, 30), rnd.randint(0, 30))}",) for _ in range(rnd.randint(0, 4))]
        cited = [(rnd.choice([str(rnd.randint(0, n - 1)), None, f"x{i}"]),) for _ in range(rnd.randint(0, 2))]
        rows.append((str(i), date, codes, cited))
    citing = {}
    for key, _, _, cited in rows:
        for (c,) in cited:
            if c is not None and c.isdigit():
                citing.setdefault(c, []).append((key,))
    full = [(*row, citing.get(row[0], [])) for row in rows]
    ddl = (
        f"{K} string, publication_date bigint, cpc array<struct<code:string>>, "
        f"citation array<struct<{K}:string>>, cited_by array<struct<{K}:string>>"
    )
    return full, spark.createDataFrame(full, ddl)


def labels(n, rnd):
    out = []
    for i in range(n):
        u = rnd.random()
        out.append((str(i), "SEED" if u < 0.04 else "ANTISEED-manual" if u < 0.08 else "PC" if u < 0.1 else None))
    return out + [out[0], ("unknown", "SEED")]


def naive_expansion(rows, labelled, n_pc):
    """The expansion written out with plain loops."""
    block = [(k, lv) for k, lv in labelled if lv and "SEED" in lv]
    by_key = {row[0]: row for row in rows}
    seeds = [k for k, lv in block if lv == "SEED"]
    freq = {}
    for k in seeds:
        for (code,) in by_key[k][2] if k in by_key else []:
            freq[code] = freq.get(code, 0) + 1
    years = sorted(by_key[k][1] // 10000 for k in seeds if k in by_key)
    pick = lambda q: years[max(0, -(-int(q * 100 * len(years)) // 100) - 1)]
    low, high = pick(0.25) * 10000, pick(0.75) * 10000
    universe = [row for row in rows if low <= row[1] <= high]
    ufreq = {}
    for row in universe:
        for (code,) in row[2]:
            ufreq[code] = ufreq.get(code, 0) + 1
    odds = {c: (n / len(seeds)) / (ufreq[c] / len(universe)) for c, n in freq.items() if c in ufreq}
    top = set(sorted(odds, key=lambda c: (-odds[c], c))[:n_pc])
    pc = {row[0] for row in rows if any(code in top for (code,) in row[2])}
    raw = list(block) + [(k, "PC") for k in pc]
    frontier = set(seeds) | pc
    for level in ("L1", "L2"):
        back = {c for k in frontier if k in by_key for (c,) in by_key[k][3] if c is not None}
        forward = {c for k in frontier if k in by_key for (c,) in by_key[k][4]}
        raw += [(k, f"{level}-BACK") for k in back] + [(k, f"{level}-FOR") for k in forward]
        frontier = back | forward
    grouped = {}
    for k, lv in raw:
        grouped.setdefault(k, []).append(lv)
    order = ["SEED", "PC", "L1-BACK", "L1-FOR", "L2-BACK", "L2-FOR"]
    result = []
    for k, lvs in grouped.items():
        best = "ANTISEED" if any("ANTISEED" in v for v in lvs) else next(o for o in order if o in lvs)
        result.append((k, best, ",".join(sorted(lvs)), len(lvs)))
    return sorted(result)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_expansion_equals_plain_loops(spark, rows, seed):
    data, publications = graph(spark, seed=seed)
    labelled = labels(len(data), random.Random(seed))
    got = x.expand(
        table(spark, labelled, f"{K} string, expansion_level string"),
        publications,
        class_pairs(publications, K, "cpc"),
        citation_links(publications, K),
        K,
        n_pc=3,
    )
    assert rows(got) == naive_expansion(data, labelled, 3)


def test_composed_rounds_equal_the_fused_plan(spark, rows):
    data, publications = graph(spark)
    labelled = table(spark, labels(len(data), random.Random(5)), f"{K} string, expansion_level string")
    codes, links = class_pairs(publications, K, "cpc"), citation_links(publications, K)
    block = x.seed_block(labelled, K)
    raw = block.unionByName(x.full_class_expansion(block, publications, codes, K, 3))
    for level in (1, 2):
        raw = raw.unionByName(x.full_citation_expansion(raw, links, K, level))
    fused = x.expand(labelled, publications, codes, links, K, n_pc=3)
    assert rows(x.reduce_expansion(raw, K)) == rows(fused)
    one_by_one = x.citation_expansion(raw, links, K, "BACK", 1).unionByName(x.citation_expansion(raw, links, K, "FOR", 1))
    assert rows(one_by_one) == rows(x.full_citation_expansion(raw, links, K, 1))


def test_precomputed_odds_and_more_codes(spark):
    data, publications = graph(spark)
    labelled = table(spark, labels(len(data), random.Random(5)), f"{K} string, expansion_level string")
    codes = class_pairs(publications, K, "cpc")
    block = x.seed_block(labelled, K)
    odds = table(spark, [("C1", 2.0), ("C2", 1.0), ("C99", 9.0)], "code string, odds double")
    few = x.full_class_expansion(block, publications, codes, K, 2, odds=odds)
    more = x.full_class_expansion(block, publications, codes, K, 3, odds=odds)
    assert few.join(more, K, "left_anti").count() == 0 and more.count() > few.count()
    assert x.class_expansion(odds, codes, K, 1).count() == 0
    lost = x.class_expansion(odds, codes, K, 1, keep_unmatched=True).collect()
    assert [tuple(row) for row in lost] == [(None, "PC")]


def test_year_window_leaves_its_last_year_out(spark, rows):
    pubs = table(spark, [("a", 19990101), ("b", 20010505), ("c", 20010000), ("d", 20001231)], f"{K} string, publication_date bigint")
    codes = pubs.withColumn("code", F.lit("X"))
    window = table(spark, [(1999, 2001)], "p25 bigint, p75 bigint")
    assert rows(x.universe_class_freq(codes, pubs, window)) == [("X", 3, 3, 1.0)]


def test_seed_frequency_counts_repeats_and_absent_members(spark, rows):
    block = table(spark, [("a", "SEED"), ("a", "SEED"), ("z", "SEED"), ("b", "ANTISEED-manual")], f"{K} string, expansion_level string")
    codes = table(spark, [("a", "X"), ("a", "X"), ("a", "Y"), ("b", "Z"), ("a", None)], f"{K} string, code string")
    got = rows(x.seed_class_freq(block, codes, K))
    assert got == sorted([("X", 4, 3, 4 / 3), ("Y", 2, 3, 2 / 3), (None, 0, 3, 0.0)], key=repr)


def test_seed_share(spark):
    labelled = spark.range(1000).select(F.col("id").cast("string").alias(K), F.lit("SEED").alias("expansion_level"))
    assert x.seed_block(labelled, K, share=0).count() == 1000
    half = x.seed_block(labelled, K, share=0.5, draw_seed=1)
    assert 430 < half.count() < 570
    assert half.exceptAll(x.seed_block(labelled, K, share=0.7, draw_seed=1)).count() == 0


def test_levels_beyond_the_known_ones_are_ranked_and_listed(spark, rows):
    raw = [(1, "SEED-2"), (1, "L3-FOR"), (2, "ANTISEED-other"), (2, "SEED"), (3, "L3-FOR"), (3, "L3-FOR"), (4, None), (5, "L2-BACK"), (5, "x")]
    found = x.reduce_expansion(spark.createDataFrame(raw, "k int, expansion_level string"), "k")
    assert rows(found, "k", "expansion_level", "expansion_level_", "nb_match") == [
        (1, "SEED", "L3-FOR,SEED-2", 2),
        (2, "ANTISEED", "ANTISEED-other,SEED", 2),
        (3, None, "L3-FOR,L3-FOR", 2),
        (4, None, None, 0),
        (5, "L2-BACK", "L2-BACK,x", 2),
    ]


def test_reduced_levels(spark, rows):
    raw = table(
        spark,
        [("a", "ANTISEED-manual"), ("a", "PC"), ("b", "L2-FOR"), ("b", "L1-BACK"), ("c", "SEED"), ("c", "SEED"), (None, "PC"), ("d", None)],
        f"{K} string, expansion_level string",
    )
    assert rows(x.reduce_expansion(raw, K)) == sorted(
        [
            ("a", "ANTISEED", "ANTISEED-manual,PC", 2),
            ("b", "L1-BACK", "L1-BACK,L2-FOR", 2),
            ("c", "SEED", "SEED,SEED", 2),
            (None, "PC", "PC", 1),
            ("d", None, None, 0),
        ],
        key=repr,
    )


def test_close_antiseed(spark):
    codes = table(spark, [(str(i), "G06Q20/32" if i % 2 else "H04L9/00") for i in range(100)], f"{K} string, code string")
    expansion = table(spark, [(str(i),) for i in range(0, 50)], f"{K} string")
    got = x.close_antiseed(codes, ["G06Q20/00"], 100, expansion, K, draw_seed=1)
    assert {int(row[K]) for row in got.collect()} == set(range(51, 100, 2))
    assert x.close_antiseed(codes, ["G06Q20/00"], 100, expansion, K, exclude_expansion=False).count() == 50
    located = table(spark, [("51", ["FR"]), ("53", ["US", "FR"]), ("55", [])], f"{K} string, country_code array<string>")
    assert x.close_antiseed(codes, ["G06Q"], 9, expansion, K, located=located).count() == 2
    assert x.close_antiseed(codes, ["G06Q"], 9, expansion, K, located=located, countries=["US"]).count() == 1


def test_runs_equal_single_expansions(spark, rows):
    """Seventy runs, so more than one word of bits, against one expansion at a time."""
    data, publications = graph(spark)
    both = [("one", *row) for row in labels(len(data), random.Random(5))] + [
        ("two", *row) for row in labels(len(data), random.Random(6))
    ]
    labelled = table(spark, both, f"technology string, {K} string, expansion_level string")
    codes, links = class_pairs(publications, K, "cpc"), citation_links(publications, K)
    runs = r.plan_runs(["one", "two"], [0.5, 0.9], 17) + r.plan_runs(["one"], [1.0], 2)
    members = r.expand_runs(labelled, publications, codes, links, K, runs, n_pc=3)
    assert "m1" in members.columns
    by_run = r.members_by_run(members, K, runs)
    for run in (runs[0], runs[20], runs[67], runs[69]):
        own = labelled.filter(F.col("technology") == run.technology)
        single = x.expand(own, publications, codes, links, K, share=run.share, draw_seed=run.seed, n_pc=3)
        got = by_run.filter(F.col("run_id") == run.run_id)
        assert rows(got, K) == rows(single.filter(F.col(K).isNotNull()), K)
    from_bits, from_rows = r.patterns_from_members(members, runs), r.run_patterns(by_run, K)
    columns = ["technology", "seed_share", "runs", "n"]
    assert rows(from_bits, *columns) == rows(from_rows, *columns)


def test_runs_read_codes_and_members_once(spark):
    """Whatever reads the codes, or the counted sets of runs, does not make them anew."""
    data, publications = graph(spark, 60)
    labelled = table(spark, [("one", *row) for row in labels(len(data), random.Random(5))], f"technology string, {K} string, expansion_level string")
    read, counted = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def seen(total):
        return F.udf(lambda value: (total.add(1), value)[1], "string").asNondeterministic()

    codes = class_pairs(publications, K, "cpc").where("code is not null")
    runs = r.plan_runs(["one"], [0.9], 3)
    marked = codes.withColumn("code", seen(read)("code"))
    members = r.expand_runs(labelled, publications, marked, citation_links(publications, K), K, runs, n_pc=3)
    members = members.withColumn(K, seen(counted)(K)).where(f"{K} <> ''")
    patterns = r.patterns_from_members(members, runs)
    assert r.pair_overlap(patterns).count() == 3 and r.batch_overlap(patterns).count() == 3
    assert read.value == codes.count()
    assert counted.value == members.count() > 0


def test_overlaps(spark, rows):
    data = [("a", 1), ("a", 2), ("a", 3), ("a", None), ("b", 2), ("b", 3), ("c", 9)]
    df = table(spark, [("t", 0.5, run, k) for run, k in data], f"technology string, seed_share double, run_id string, {K} int")
    patterns = r.run_patterns(df, K)
    assert rows(r.run_sizes(patterns), "run_id", "nb") == [("a", 3), ("b", 2), ("c", 1)]
    pairs = r.pair_overlap(patterns)
    got = rows(pairs, "left_name", "right_name", "nb_overlap", "share_left", "share_right")
    assert got == [("a", "b", 2, 2 / 3, 1.0), ("a", "c", 0, 0.0, 0.0), ("b", "c", 0, 0.0, 0.0)]
    assert r.pair_ratios(pairs).count() == 6
    assert rows(r.batch_overlap(patterns), "run_id", "nb_all", "share") == [("a", 0, 0.0), ("b", 0, 0.0), ("c", 0, 0.0)]
    two = r.batch_overlap(r.run_patterns(df.filter("run_id <> 'c'"), K))
    assert rows(two, "run_id", "share") == [("a", 2 / 3), ("b", 1.0)]
    with pytest.raises(ValueError):
        r.overlap_analysis(patterns, "triples")


def test_hot_hub_and_hot_code(spark):
    """A third of all links at one hub and one code on every item: same answer, no list per key."""
    n = 3000
    pairs = spark.range(n).select(F.col("id").alias("citing"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") + 1).cast("bigint").alias("cited"))
    links = x.both_directions(pairs, "citing", "cited")
    raw = table(spark, [(0, "SEED")], "key bigint, expansion_level string")
    reached = x.full_citation_expansion(raw, links, "key", 1)
    assert dict(reached.groupBy("expansion_level").count().collect()) == {"L1-FOR": n // 3, "L1-BACK": 1}


@pytest.mark.parametrize("hub", [100_000, 3])
def test_stored_links_do_not_move(spark, rows, hub):
    """Two rounds over stored links, hubs apart or not, equal those over plain ones; nothing above the links is exchanged."""
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "a"), ("y", "x"), ("h", "a")] + [("h", f"t{i}") for i in range(9)] + [(f"s{i}", "h") for i in range(5)] + [("a", "b"), (None, "a")]
    links = x.both_directions(spark.createDataFrame(pairs, "citing string, cited string"), "citing", "cited")
    stored = x.store_links(links, buckets=8, hub=hub)
    assert (stored.hub_keys.count() == 0) == (hub > 100)
    raw = spark.createDataFrame([("a", "SEED"), ("b", "PC"), ("h", "ANTISEED-manual"), (None, "SEED")], "k string, expansion_level string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for level in (1, 2):
            start = raw if level == 1 else first
            found = x.full_citation_expansion(start, stored, "k", level)
            assert rows(found.dropDuplicates()) == rows(x.full_citation_expansion(start, links, "k", level).dropDuplicates())
            first = found
        followed = x.follow(stored, raw.select(F.col("k").alias("key")).distinct())
        plan = followed._jdf.queryExecution().executedPlan().toString()
        below = [part for part in plan.split("SortMergeJoin")[1:] if "Bucketed: true" in part]
        assert below and all("Exchange hashpartitioning" not in line for part in below for line in part.splitlines()[1:3])
        single = spark.createDataFrame([("a", 1), ("h", 2)], "key string, m0 long")
        inner = [x.follow(way, single, "inner").select("key", "target", "kind", "m0") for way in (stored, links)]
        assert rows(inner[0]) == rows(inner[1])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_expansions_run_in_partitions_of_a_bounded_size(spark, monkeypatch):
    """What an expansion moves runs inside small shuffles, and the session's own numbers come back."""
    given = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    seen = {}

    def watched(module):
        run = module.materialise

        def materialise(df):
            own = {name: spark.conf.get(name) for name in given}
            seen.setdefault(module, []).append((df.columns, own != given and int(own["spark.sql.shuffle.partitions"])))
            return run(df)

        monkeypatch.setattr(module, "materialise", materialise)

    watched(x), watched(r)
    _, publications = graph(spark, 40)
    labelled = table(spark, [("one", str(i), "SEED") for i in range(9)], f"technology string, {K} string, expansion_level string")
    args = (publications, class_pairs(publications, K, "cpc"), citation_links(publications, K), K)
    x.expand(labelled.drop("technology"), *args, n_pc=3)
    assert "nb_match" in seen[x][-1][0] and seen[x][-1][1] >= 200
    r.expand_runs(labelled, *args, r.plan_runs(["one"], [0.9], 3), n_pc=3)
    assert all(partitions >= 200 for _, partitions in seen[r]) and seen[r][-1][0] == [K, "m0"]
    assert {name: spark.conf.get(name) for name in given} == given


def test_sets_of_runs_are_told_apart_where_they_lie(spark, rows, monkeypatch):
    """One shuffle, of the sets within a technology and share; the ids of every key's runs are not moved."""
    plans = []
    monkeypatch.setattr(r, "materialise", lambda df, run=r.materialise: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), run(df))[1])
    runs = r.plan_runs(["one", "two"], [0.5, 0.9], 20)
    of_key = [sorted({random.Random(k).randrange(80) for _ in range(k % 7)}) for k in range(60)]
    places = {run.run_id: i for i, run in enumerate(sorted(runs, key=lambda run: run.run_id))}
    ids = sorted(places)
    members = table(spark, [(k, sum(1 << i for i in own if i < 62), sum(1 << i - 62 for i in own if i >= 62)) for k, own in enumerate(of_key)], "k int, m0 long, m1 long")
    got = r.patterns_from_members(members, runs)
    columns = ["technology", "seed_share", "runs", "n"]
    named = {run.run_id: run for run in runs}
    by_run = table(spark, [(named[ids[i]].technology, named[ids[i]].share, ids[i], k) for k, own in enumerate(of_key) for i in own], "technology string, seed_share double, run_id string, k int")
    assert rows(got, *columns) == rows(r.run_patterns(by_run, "k"), *columns)
    assert len(plans) == 1 and plans[0].count("Aggregate") == 1 and "run_id" not in plans[0]
