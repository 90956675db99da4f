import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ligature.functions.tokens import tokens
from ligature.operators import candidates, clean, ledger, order, pairs, plugs, pocket, quality, runs, splits, vocab


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_types_lines(spark):
    lines = ["0 0.0000 7.6830 a_rec_x.gninatypes a_lig_x.gninatypes 7.6830", "0 0.5 7.6830 a_rec_x a_lig_x", "1 2.5 P/r.gninatypes P/l.gninatypes", "# no", "", "1 x r l", "1 2"]
    df = frame(spark, [(x,) for x in lines], "line string")
    got = [tuple(r) if r else None for (r,) in df.select(pairs.parse_types_line(F.col("line"))).collect()]
    assert got == [(0.0, "7.6830", "a_rec_x.gninatypes"), (7.683, "a_rec_x", "a_lig_x"), (2.5, "P/r.gninatypes", "P/l.gninatypes"), None, None, None, None]
    checked = df.select(pairs.parse_types_line(F.col("line"), "checked")).first()[0]
    assert tuple(checked) == (7.683, "a_rec_x.gninatypes", "a_lig_x.gninatypes")
    keys = [r[0] for r in df.limit(2).select(pairs.affinity_key(F.lit("a_rec_x.gninatypes"))).collect()]
    assert keys[0] == "a_rec.x"


def test_affinity_walk(spark):
    log = frame(spark, [(1, 1.0, "P/r_rec_0.gninatypes", "P/l_lig_0.gninatypes"), (2, 2.0, "P/r_rec_0.gninatypes", "P/l_lig_0.gninatypes")], "n int, affinity double, receptor string, ligand string")
    table = pairs.affinity_table(log, ["n"])
    assert {(r["rec_key"], r["affinity"]) for r in table.collect()} == {("P/r_rec.0", 2.0), ("r_rec_0.gninatypes", 2.0)}
    wanted = frame(spark, [("x/r_rec_0.pdb", "x/l_lig_0.pdb"), ("crossdocked/P/r_rec.0", "crossdocked/P/l_lig.0"), ("no", "no")], "receptor string, ligand string")
    got = {r["receptor"]: r["affinity"] for r in pairs.lookup_affinity(wanted, table).collect()}
    assert got == {"x/r_rec_0.pdb": 2.0, "crossdocked/P/r_rec.0": 2.0, "no": None}


def test_paths(spark):
    p = F.col("p")
    df = frame(spark, [("a/b/c.tar.gz",), ("c",), (".hid",)], "p string")
    assert [tuple(r) for r in df.select(pairs.path_name(p), pairs.path_stem(p), pairs.path_parent(p)).collect()] == [("c.tar.gz", "c.tar", "b"), ("c", "c", ""), (".hid", ".hid", "")]


def test_grid_join_is_the_distance_test(spark):
    import random

    rnd = random.Random(1)
    rows = [(i % 3, "lig" if i % 4 == 0 else "rec", i, "A", i, "ALA" if i % 5 else "MSE", rnd.uniform(-2, 2), rnd.uniform(-2, 2), rnd.uniform(-2, 2)) for i in range(240)]
    atoms = frame(spark, rows, "complex_id int, entity string, atom_id int, chain string, resnum int, resname string, x double, y double, z double")
    for cutoff in (0.1, 0.7, 2.0):
        got = {r["atom_id"] for r in pocket.within_cutoff(atoms.filter("entity = 'rec'"), atoms.filter("entity = 'lig'"), cutoff, ["complex_id"]).collect()}
        assert got == {a[2] for a in rows for b in rows if a[1] == "rec" and b[1] == "lig" and a[0] == b[0] and math.dist(a[6:], b[6:]) <= cutoff}
    with_x = {r["complex_id"]: r["pocket"] for r in pocket.pocket_sequence(atoms, 2.0).collect()}
    without = {r["complex_id"]: r["pocket"] for r in pocket.pocket_sequence(atoms, 2.0, "drop").collect()}
    assert all(set(v) == {"A", "X"} for v in with_x.values()) and all(set(v) == {"A"} for v in without.values())


def test_positions_splits_and_shards(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k")).repartition(5)
    got = {r["k"]: r["idx"] for r in order.with_position(df, ["k"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got) and sorted(got.values()) == list(range(1000))
    parts = splits.positional_split(df, ["k"], 100).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 900, "val": 100}
    sizes = sorted((r["shard"], r["count"]) for r in splits.shard(df, ["k"], 3, "range").groupBy("shard").count().collect())
    assert sizes == [(0, 334), (1, 333), (2, 333)]
    moved = splits.block_shuffle(df, ["k"], 10).collect()
    assert all(r["idx"] // 10 == r["place"] // 10 for r in moved) and sorted(r["place"] for r in moved) == list(range(1000))
    assert order.with_position(df.limit(0), ["k"]).count() == 0


def test_positions_of_tied_first_columns(spark):
    """Most rows share one value of the first column; none of the ranges holds most of them."""
    df = spark.range(4000).select(F.when(F.col("id") % 10 < 9, 5).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 7919 % 4001).alias("j"), F.col("id").cast("string").alias("s")).repartition(5)
    for keys in (["k", "j"], ["k", "s"], ["k", "j", "s"]):
        got = sorted(order.with_position(df, keys).collect(), key=lambda r: r["idx"])
        assert [r["idx"] for r in got] == list(range(4000)) and [[r[c] for c in keys] for r in got] == sorted([r[c] for c in keys] for r in got)
    plan = order.with_position(df, ["k", "j"])._jdf.queryExecution().toString()
    assert "_part" in plan
    odd = frame(spark, [(None, 1), (2.0, 2), (float("nan"), 3), (2.0, 1)], "k double, j int")
    assert [(r["idx"], r["j"]) for r in order.with_position(odd, ["k", "j"]).orderBy("idx").collect()] == [(0, 1), (1, 1), (2, 2), (3, 3)]


def test_spread_deals_few_parts_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert order.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    assert order.spread(spark.range(10, numPartitions=cores + 3)).rdd.getNumPartitions() == cores + 3


def test_padding(spark):
    df = frame(spark, [(0, [1, 2]), (1, [1, 2, 3, 4]), (2, [9])], "idx long, ids array<int>")
    got = {r["idx"]: (r["ids"], r["mask"]) for r in splits.pad_batches(df, "ids", 2, 3).collect()}
    assert got == {0: ([1, 2, 0], [1, 1, 0]), 1: ([1, 2, 3], [1, 1, 1]), 2: ([9], [1])}


def test_vocabulary_ties_by_first_place(spark):
    df = frame(spark, [(0, "NOC"), (1, "CON"), (2, "F")], "mol_id long, smiles string")
    assert [r["token"] for r in vocab.build_vocab(df, 2).filter("not special").orderBy("token_id").collect()] == ["N", "O"]
    merges = frame(spark, [("a b",), ("a b c",), ("x",)], "line string")
    assert {r["token"] for r in vocab.vocab_from_merges(merges).collect()} == {"a", "b", "ab"}


def test_top_k_and_nucleus(spark):
    p = [0.5, 0.3, 0.15, 0.05]
    df = frame(spark, [(1, i, math.log(x)) for i, x in enumerate(p)], "q long, tok long, logit double")
    assert {r["tok"] for r in candidates.top_p(df, 0.7).collect()} == {0, 1}
    assert {r["tok"] for r in candidates.top_p(df, 0.1).collect()} == {0}
    tied = frame(spark, [(1, i, x) for i, x in enumerate([3.0, 2.0, 2.0, 1.0])], "q long, tok long, logit double")
    assert candidates.top_k(tied, 2).count() == 3 and candidates.top_k(tied, 2, ties=False).count() == 2
    seen = frame(spark, [(1, 0), (1, 0)], "q long, tok long")
    low = frame(spark, [(1, 0, -2.0), (1, 1, 4.0)], "q long, tok long, logit double")
    assert {r["tok"]: r["logit"] for r in candidates.repetition_penalty(low, seen, 2.0).collect()} == {0: -1.0, 1: 4.0}
    assert {r["tok"]: r["logit"] for r in candidates.repetition_penalty(low, seen, 2.0, True).collect()} == {0: -4.0, 1: 4.0}


def test_grammar_state_by_loop(spark):
    import random

    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["C", "c", "1", "2", "(", ")", "=", "/", "[NH]", "%10"]) for _ in range(rnd.randint(0, 18))) for _ in range(80)]
    df = frame(spark, [(i, t) for i, t in enumerate(texts)], "k int, s string").select("k", tokens(F.col("s")).alias("t"))
    got = {(r["k"], r["pos"]): r for r in candidates.prefix_state(df, "k", "t").collect()}
    for k, row in ((r["k"], r["t"]) for r in df.collect()):
        depth, rings, last, since, aromatic = 0, {}, "other", 0, 0
        for i, t in enumerate(row):
            r = got[k, i]
            assert (r["paren_balance"], r["open_rings"], r["aromatic_depth"], r["last_class"], r["tokens_since_atom"]) == (depth, len(rings), aromatic, last, since), (row, i)
            depth += (t == "(") - (t == ")")
            if t.strip("%").isdigit():
                if t in rings:
                    aromatic -= rings.pop(t)
                else:
                    rings[t] = last == "aromatic_atom"
                    aromatic += rings[t]
            cls = {"C": "atom", "c": "aromatic_atom", "[NH]": "bracket_atom", "=": "bond", "/": "stereo"}.get(t)
            last, since = cls or last, 0 if cls and "atom" in cls else since + 1
    bad = frame(spark, [(1, "C(=C")], "k int, s string").select("k", tokens(F.col("s")).alias("t"))
    assert candidates.grammar_audit(bad, "k", "t").count() == 0
    assert candidates.grammar_audit(bad, "k", "t", strict=True).first()["rule"] == "bond_after_paren"


@pytest.mark.parametrize("gamma,lam", [(0.99, 0.95), (1.0, 1.0), (0.9, 0.1), (0.5, 0.0), (0.001, 0.5)])
def test_advantages_of_long_sequences(spark, gamma, lam):
    rnd = random.Random(1)
    rows = [(k, i, rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for k, n in ((1, 9000), (2, 64), (3, 65), (4, 1), (5, 4097)) for i in range(n)]
    out = {(r["seq_id"], r["step"]): (r["advantage"], r["returns"]) for r in runs.gae(frame(spark, rows, "seq_id long, step int, value double, reward double").repartition(3), gamma, lam).collect()}
    assert len(out) == len(rows)
    after, last = 0.0, None
    for k, i, value, reward in sorted(rows, key=lambda r: (r[0], -r[1])):
        if k != last:
            follow, after, last = 0.0, 0.0, k
        after = reward + gamma * follow - value + gamma * lam * after
        follow = value
        assert abs(out[k, i][0] - after) < 1e-8 and abs(out[k, i][1] - after - value) < 1e-8


def test_ledger_counts_the_first_of_each_key(spark):
    rows = [(1, "C", None), (2, "C", None), (3, None, "bad"), (4, None, "bad"), (5, "O", "bad"), (6, "O", None), (7, None, None), (8, None, None)]
    out = {r["n"]: r["outcome"] for r in ledger.ledger(frame(spark, rows, "n int, smiles string, reason string"), "smiles", "n").collect()}
    assert out == {1: "ok", 2: "Duplicate SMILES", 3: "bad", 4: "bad", 5: "bad", 6: "ok", 7: "ok", 8: "Duplicate SMILES"}


def test_metric_records_hold_numbers(spark):
    fixed = {"epoch": F.lit(3), "phase": F.lit("a"), "train_loss": F.lit(0.5)}
    df = spark.range(1).select(runs.metric_record(fixed, F.create_map(F.lit("ppo_x"), F.lit(1.5), F.lit("other"), F.lit(2.0))).alias("a"), runs.metric_record({}, F.create_map(F.lit("z"), F.lit(1))).alias("b"))
    one, two = (json.loads(x) for x in df.first())
    assert one == dict.fromkeys(runs.FIXED_KEYS) | {"epoch": 3, "phase": "a", "train_loss": 0.5, "train_ppo_x": 1.5}
    assert two == dict.fromkeys(runs.FIXED_KEYS)
    with pytest.raises(ValueError):
        runs.metric_record({"loss": F.lit(1)}, F.create_map(F.lit("z"), F.lit(1)))


def test_lookup_in_the_log_agrees_with_the_whole_table(spark):
    lines = [(k, f"1 0.5 {k}.5 r{k % 3}_rec_0 l{k % 4}_lig_0") for k in range(40)]
    log = pairs.types_log(frame(spark, lines, "n int, line string"))
    wanted = frame(spark, [(f"crossdocked/P/r{i}_rec.0", f"crossdocked/P/l{j}_lig.0") for i in range(4) for j in range(5)], "receptor string, ligand string")
    one, two = pairs.lookup_in_log(wanted, log, ["n"]), pairs.lookup_affinity(wanted, pairs.affinity_table(log, ["n"]))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str) and one.filter("affinity is not null").count() == 12


def test_advantages(spark):
    df = frame(spark, [(1, 0, 1.0, 0.0), (1, 1, 2.0, 1.0)], "seq_id long, step int, value double, reward double")
    assert {r["step"]: r["advantage"] for r in runs.gae(df, 1.0, 1.0).collect()} == {0: 0.0, 1: -1.0}


def test_best_so_far(spark):
    df = frame(spark, [("r", i, x) for i, x in enumerate([3.0, 2.0, 2.0, 1.0, float("nan")])], "run string, step int, loss double")
    assert [r["is_best"] for r in runs.best_so_far(df, "run", "step", "loss").orderBy("step").collect()] == [True, True, False, True, False]


def test_stability_alarms(spark):
    rows = [(1, i, 1e-9 if i > 70 else 1.0, 20.0 if i == 60 else 1.0) for i in range(90)] + [(2, i, float("nan") if i == 55 else 1.0, 1.0) for i in range(90)]
    out = runs.stability(frame(spark, rows, "run_id long, step int, loss double, grad_norm double"), patience=20)
    hits = lambda name, run: [r["step"] for r in out.filter((F.col("run_id") == run) & F.col(name)).orderBy("step").collect()]
    assert hits("exploding_gradients", 1) == list(range(60, 70)) and hits("numerical_instability", 1) == list(range(80, 90))
    assert hits("non_finite_loss", 2) == list(range(55, 60)) and hits("complete_stagnation", 2)[0] == 49
    assert not any(r["is_unstable"] for r in out.filter("step < 49").collect())


def test_epoch_means_count_rl_batches_once(spark):
    df = frame(spark, [(1, 2.0, True), (1, 4.0, False)], "epoch int, validity double, rl boolean")
    r = runs.epoch_metrics(df, ["epoch"], ["validity"], F.col("rl")).first()
    assert (r["mean_validity"], r["rl_mean_validity"], r["batches"], r["rl_batches"]) == (3.0, 2.0, 2, 1)


def test_reports_of_nothing(spark):
    none = frame(spark, [], "smiles string, qed double, mw double, logp double, is_drug_like boolean")
    r = quality.generation_report(none, "smiles", F.lit(True)).first()
    assert (r["total_generated"], r["validity"], r["uniqueness"], r["avg_qed"]) == (0, 0.0, 0.0, 0.0)
    assert quality.novelty(none, none, "smiles").first()["novelty"] == 0.0


def test_incomplete_rows(spark):
    df = frame(spark, [(" a ", 1.0), ("", 1.0), ("b", float("nan")), (None, 2.0)], "s string, x double")
    assert [tuple(r) for r in clean.drop_incomplete(df, ["s", "x"]).collect()] == [("a", 1.0)]
    filled = clean.fill_affinity(df.withColumnRenamed("x", "affinity")).collect()
    assert [(r["affinity"], r["affinity_found"]) for r in filled] == [(1.0, True), (1.0, True), (5.0, False), (2.0, True)]


def test_ledger_and_plugs(spark):
    import pandas as pd

    df = frame(spark, [(1, "CC"), (2, "CC"), (3, "?"), (4, "CO")], "mol_id long, smiles string")
    assert {r["outcome"]: r["n"] for r in ledger.ledger_stats(plugs.convert_with_ledger(df)).collect()} == {"ok": 2, "Duplicate SMILES": 1, "conversion_failed": 1}

    def fake(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"processed": s, "converted": s.str.lower(), "error": s.map(lambda x: "bad" if x == "CO" else None)})

    assert {r["outcome"]: r["n"] for r in ledger.ledger_stats(plugs.convert_with_ledger(df, fake)).collect()} == {"ok": 2, "Duplicate SMILES": 1, "bad": 1}
    assert [r[0] for r in df.select(plugs.validity(F.col("smiles"), lambda s: s == "CC")).collect()] == [True, True, False, False]
    many = plugs.variants_plug(lambda s: s.map(lambda x: [x + "C", x]))
    out = splits.augment(df.withColumn("v", many(F.col("smiles"))), "mol_id", "smiles", "v", 2)
    assert out.filter("mol_id = 1").orderBy("variant_no").select("smiles").collect() == [("CC",), ("CCC",)]


def test_properties_by_table_and_plug(spark):
    df = frame(spark, [(1, "CC", "x"), (2, "CC", "y"), (3, "N", None), (4, None, "z"), (5, "bad", "x"), (6, "O", "")], "mol_id int, smiles string, size string")
    known = frame(spark, [("N", 9, "a"), ("N", 8, "b"), (None, 7, "c"), ("unused", 1, "d")], "smiles string, size int, note string")
    asked = spark.sparkContext.accumulator(0)

    def properties(text):
        import pandas as pd

        asked.add(len(text))
        return pd.DataFrame({"size": text.str.len().where(text != "bad"), "note": text.where(text != "bad")})

    out = plugs.with_properties(df, properties, "size long, note string", known=known)
    assert out.columns == ["mol_id", "smiles", "size", "properties"]
    got = {r["mol_id"]: r["properties"] and tuple(r["properties"]) for r in out.collect()}
    assert got == {1: (2, "CC"), 2: (2, "CC"), 3: (8, "b"), 4: None, 5: None, 6: (1, "O")}
    assert asked.value == 3  # CC once, bad, O
    alone = plugs.with_properties(df.limit(0), properties, "size long, note string")
    assert alone.count() == 0 and alone.columns == out.columns


def test_rows_move_only_from_few_parts():
    assert order.too_few(1, 8) and order.too_few(7, 8) and not order.too_few(8, 8)
    assert order.too_few(64, 10_000) and order.too_few(999, 10_000) and not order.too_few(9_000, 10_000)
    assert not order.too_few(100, 500) and order.too_few(60, 500)


@pytest.mark.parametrize("kind, top", [("long", 2**63 - 1), ("int", 2**31 - 1), ("string", "9")])
def test_tokens_are_counted_without_a_sort(spark, kind, top):
    keys = ["5", "5", "1", top, None, None, "0"] if kind == "string" else [5, 5, -top - 1, top, None, None, 0]
    rows = list(zip(keys, ["CCO", "OC", "NC", "BrC", "SN", "CS", "FO"]))
    counts = vocab.token_counts(spark.createDataFrame(rows, f"mol_id {kind}, smiles string"))
    want = {"C": (6, None, 0), "O": (3, "0" if kind == "string" else 0, 1), "N": (2, None, 1), "S": (2, None, 0), "Br": (1, top, 0), "F": (1, "0" if kind == "string" else 0, 0)}
    assert {r["token"]: tuple(r)[1:] for r in counts.collect()} == want
    if kind != "string":
        assert "SortAggregate" not in counts._jdf.queryExecution().executedPlan().toString()


def test_a_log_line_is_parsed_once(spark):
    given = ["# no", "1 2.5 P1/r_rec_0.gninatypes P1/l_lig_0.gninatypes", "1 0 -3 P1_rec P1_lig", "1 0 x P1_rec P1_lig", "", None]
    log = pairs.types_log(spark.createDataFrame([(i, x) for i, x in enumerate(given)], "line_no int, line string"))
    assert sorted(map(tuple, log.drop("line").collect())) == [(1, 2.5, "P1/r_rec_0.gninatypes", "P1/l_lig_0.gninatypes"), (2, -3.0, "P1_rec", "P1_lig")]
    assert log.columns == ["line_no", "line", "affinity", "receptor", "ligand"]
    assert log._jdf.queryExecution().optimizedPlan().toString().count("\\s+") == 1
