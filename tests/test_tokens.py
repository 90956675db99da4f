import random
import re

import pytest
from pyspark.sql import functions as F

from ligature.functions import tokens as T
from ligature.functions.scores import rl_weight, sa_norm, tf_prob
from ligature.functions.validate import describe_violation, violations
from ligature.operators import clean


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(column).collect()]


@pytest.fixture(autouse=True)
def column_s(spark):
    globals()["S"] = F.col("s")  # needs the session


def test_token_cases(spark):
    assert one(spark, T.tokens(S), "CC(=O)Cl", "C[C@@H](N).x", "", None) == [["C", "C", "(", "=", "O", ")", "Cl"], ["C", "[C@@H]", "(", "N", ")"], [], None]
    assert len(T.default_vocabulary()) == 90


def test_tokens_like_a_regular_expression(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("CBrlNOcnos[]()=#-/\\%0123456789@+.>H ") for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    assert one(spark, T.tokens(S), *texts) == [re.findall(T.TOKEN_PATTERN, t) for t in texts]


def test_encode_and_decode(spark):
    v = T.default_vocabulary()
    ids = one(spark, T.encode(T.tokens(S), v), "CO", "[Xx]C")
    assert ids == [[1, v.index("C"), v.index("O"), 2], None]
    assert one(spark, T.encode(T.tokens(S), v, "unk"), "[Xx]C") == [[1, 4, v.index("C"), 2]]
    assert one(spark, T.decode(T.encode(T.tokens(S), v, "unk"), v), "C[Xx]O") == ["CO"]
    assert one(spark, T.pad_to(T.encode(T.tokens(S), v), 3), "C", "CCC") == [[1, v.index("C"), 2], [1, v.index("C"), v.index("C")]]


def test_protein_ids(spark):
    assert one(spark, T.encode_protein(S), "MKTAY", " mkx ") == [[1, 15, 13, 21, 5, 24, 2], [1, 15, 13, 3, 2]]
    assert one(spark, T.encode_protein(S, 4), "MKTAY") == [[1, 15, 13, 2]]
    assert one(spark, T.decode_protein(T.encode_protein(S)), "MKTAY") == ["MKTAY"]


def rule(s):
    """The syntax checks, stated plainly."""
    if s is None or not s.strip(" "):
        return ["empty_or_invalid"]
    s, out = s.strip(" "), []
    for o, c, close, unclosed, extra, empty in (("[", "]", "bracket_close_without_open", "unclosed_brackets", "extra_bracket_close", "empty_brackets"), ("(", ")", "paren_close_without_open", "unclosed_parentheses", "extra_paren_close", "empty_parentheses")):
        depth = 0
        for ch in s:
            depth += (ch == o) - (ch == c)
            if depth < 0:
                break
        out += [close, extra] if depth < 0 else [unclosed] if depth > 0 else []
        out += [empty] if o + c in s else []
    seen = {}
    for m in re.findall(r"%?\d+", s):
        k = int(m.lstrip("%"))
        seen[k] = seen.get(k, 0) + 1
    out += [f"unclosed_ring_{k}" if n == 1 else f"duplicate_ring_{k}" for k, n in seen.items() if n != 2]
    tests = [
        (s[0] in "=#-", "starts_with_bond"), (s[-1] in "=#-", "ends_with_bond"), (any(b + b in s for b in "=#-"), "consecutive_bonds"),
        (re.search(r"\([=#-]", s), "bond_after_open_paren"), (re.search(r"[=#-]\)", s), "bond_before_close_paren"),
        (s[0] in "/\\", "starts_with_stereo"), (s[-1] in "/\\", "ends_with_stereo"), (re.search(r"[/\\][/\\]", s), "consecutive_stereo"),
        (s[0] not in "bcnops[" and not s[0].isupper(), "invalid_start_token"), (s[0] in "])", "starts_with_closure"), (s[0].isdigit() or s[0] == "%", "starts_with_ring_digit"),
        (sum(c in "bcnops" for c in s) > 3 and not re.search(r"\d", s), "aromatic_without_rings"),
    ]
    return out + [name for test, name in tests if test]


def test_violations_by_rule(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("CNcnos[]()=#-/\\%0112233+Cl") for _ in range(rnd.randint(0, 14))) for _ in range(600)] + [None, "   ", "C[NH3+]", "))C", "CC(=O)O", "C007C7"]
    assert one(spark, violations(S), *texts) == [rule(t) for t in texts]
    assert one(spark, violations(S), "C[NH3+]", "))C") == [["unclosed_ring_3"], ["paren_close_without_open", "extra_paren_close", "invalid_start_token", "starts_with_closure"]]
    assert one(spark, violations(S, True), "C[NH3+]", "CC(=O)O", "C12CC1CC2") == [[], [], []]
    assert one(spark, describe_violation(S), "unclosed_ring_12", "x") == ["Ring closure 12 is unclosed", "Unknown violation: x"]


def test_composition_and_verdicts(spark):
    got = one(spark, T.composition(S), "C[N+](C)(C)C.[O-]C1CC1", "[Fe+3]")
    assert (got[0]["atoms"], got[0]["charge"], got[0]["charged_atoms"], got[0]["fragments"], got[0]["ring_bonds"], got[0]["bonds"], got[0]["hetero_atoms"]) == (9, 0, 2, 2, 1, 8, 2)
    assert (got[1]["elements"], got[1]["charge"]) == (["Fe"], 3)
    cases = {"": "empty_or_invalid_type", "C>>O": "reaction_smiles", "C.C.C.C": "too_many_fragments", "C?C": "parse_failed", "CC[Na].[Li]": "contains_metals_or_exotic: Li,Na", "CC[Xe]": "non_druglike_atoms: Xe", "C[N+3]C": "high_charge: 3", "[N+]C[N+]C[O-]C[O-]": "too_many_charged_atoms", "CC": "too_small", "C" * 101: "too_large", "CCO": None}
    assert [r["reason"] for r in one(spark, clean.clean_verdict(S), *cases)] == list(cases.values())
    assert one(spark, clean.largest_fragment(S), "CC.CCO.OCC", "C") == ["CCO", "C"]
    assert one(spark, clean.has_metal(S), "[Na+]", "[23Na+]", "CN") == [True, False, False]
    bad = one(spark, clean.protein_check(S), "mkt1 ", "")
    assert (bad[0]["is_valid"], bad[0]["invalid"], bad[0]["is_short"], bad[1]["is_valid"]) == (False, ["1"], True, False)


def test_schedules_and_scores(spark):
    df = spark.createDataFrame([(float(e),) for e in (0, 1, 2)], "e double")
    got = [round(r[0], 5) for r in df.select(tf_prob("inverse_sigmoid", F.col("e"), 5)).collect()]
    assert got == [0.5, 0.26894, 0.1192]
    assert [r[0] for r in df.select(rl_weight(F.col("e"), 1)).collect()] == [0.0, 0.0, 0.05]
    assert [r[0] for r in df.select(sa_norm(F.col("e") * 10)).collect()] == [1.0, 0.0, 0.0]
