import hashlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from contexture.llm import mixing
from tests.llm.helpers import BLANK, awkward, frame

WEIGHTS = {"domain": {"a": 5, "b": 3}, "language": {"en": 3}}


def fill(budget, children):
    """Water filling: ``children`` are (name, weight, supply)."""
    left = sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    out = {}
    while left:
        whole = sum(w for _, w, _ in left)
        name, weight, supply = left[0]
        if supply * whole > weight * budget:
            break
        out[name] = supply
        budget -= supply
        left = left[1:]
    upto = 0
    whole = sum(w for _, w, _ in left)
    for name, weight, _ in left:
        out[name] = budget * (upto + weight) // whole - budget * upto // whole
        upto += weight
    return out


def brute(rows, share, epochs, seed, targets=WEIGHTS):
    docs = []
    for doc_id, text, lang, source, *_ in rows:
        digit = hashlib.md5((source or "").encode()).hexdigest()[0]
        domain = "a" if digit < "6" else "b" if digit < "b" else "c"
        docs.append((doc_id, domain, lang or "", source or "", len(BLANK.findall(text or ""))))
    tree = {}
    for _, *way, n in docs:
        for depth in range(4):
            tree[tuple(way[:depth])] = tree.get(tuple(way[:depth]), 0) + n
    names = ("domain", "language", "origin")
    budget = {(): min(int(tree[()] * share), tree[()] * epochs)}
    for depth in range(3):
        for node in [n for n in tree if len(n) == depth]:
            children = [n for n in tree if n[:depth] == node and len(n) == depth + 1]
            weights = targets.get(names[depth], {})
            shares = fill(budget[node], [(c[-1], weights.get(c[-1], 1), tree[c] * epochs) for c in children])
            budget |= {c: shares[c[-1]] for c in children}
    out = []
    for leaf in [n for n in tree if len(n) == 3]:
        own = [d for d in docs if tuple(d[1:4]) == leaf]
        full = budget[leaf] // tree[leaf] if tree[leaf] else 0
        rest = budget[leaf] - full * tree[leaf]
        out += [(d[0], e, d[4]) for d in own for e in range(1, full + 1)]

        def key(d, epoch=full + 1):
            name = "" if d[0] is None else d[0]
            return hashlib.md5(f"{seed}:{epoch}:{name}:{d[4]}".encode()).hexdigest()

        upto = 0
        for d in sorted(own, key=key) if full < epochs else []:
            upto += d[4]
            if upto <= rest:
                out.append((d[0], full + 1, d[4]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share,epochs", [(0.5, 1), (1.0, 2), (3.0, 2), (0.0, 1)])
def test_choice_is_that_of_brute_force(spark, share, epochs):
    own = mixing.with_leaves(frame(spark, awkward()), mixing.source_family(), mixing.token_count())
    own = own.drop("_row")
    found = mixing.mixed(own, own, WEIGHTS, share, epochs, "s").select("doc_id", "epoch", "_tokens")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(awkward(), share, epochs, "s")


def test_own_columns_are_kept_whatever_their_names(spark):
    docs = frame(spark, awkward()).withColumn("full", F.lit(1)).withColumn("_tokens", F.lit("x"))
    found = mixing.mix_documents(docs, WEIGHTS, 1.0, 1, "s")
    assert found.columns == docs.columns and found.count() > 0


def test_empty_table(spark):
    assert mixing.mix_documents(frame(spark, []), WEIGHTS, 1.0, 2, "s").collect() == []


@pytest.mark.parametrize(
    "weights,same",
    [
        ({"en": 0.7, "de": 0.3}, {"en": 7, "de": 3, "fr": 10, "es": 10, "": 10}),
        ({"en": "0.25", "de": Fraction(1, 3)}, {"en": 3, "de": 4, "fr": 12, "es": 12, "": 12}),
        ({"en": 10**6}, {"en": 10**6}),
    ],
)
def test_fractions_are_whole_numbers_of_the_same_ratios(spark, monkeypatch, weights, same):
    rows = awkward()
    counted = mixing.with_leaves(frame(spark, rows), mixing.source_family(), mixing.token_count())
    found = mixing.mixed(counted, counted, {"language": weights}, 0.6, 2, "s")
    monkeypatch.setattr("tests.llm.test_mixing.WEIGHTS", {"language": same})
    listed = [(r["doc_id"], r["epoch"], r["_tokens"]) for r in found.select("doc_id", "epoch", "_tokens").collect()]
    assert sorted(listed, key=repr) == sorted(brute(rows, 0.6, 2, "s"), key=repr)


def test_a_weight_of_nothing_leaves_out_and_a_negative_one_is_refused(spark):
    rows = awkward()
    counted = mixing.with_leaves(frame(spark, rows), mixing.source_family(), mixing.token_count())
    found = mixing.mixed(counted, counted, {"language": {"en": 1, "fr": 0, "es": 0}}, 1.0, 1, "s")
    kept = {r["_language"] for r in found.collect()}
    assert "en" in kept and not kept & {"fr", "es"}
    every = {r[0] for r in rows if (r[2] or "") not in ("fr", "es")}
    assert {r["doc_id"] for r in found.collect()} == every
    none = mixing.mixed(counted, counted, {"language": dict.fromkeys(["en", "de", "fr", "es", ""], 0)}, 1.0, 1, "s")
    assert none.collect() == []
    with pytest.raises(ValueError):
        mixing.mixed(counted, counted, {"language": {"en": -1}}, 1.0, 1, "s")


def test_products_beyond_64_bits(spark):
    """3 x 10^13 tokens and a weight of 10^6, as at 100 TB."""
    schema = "doc_id bigint, _domain string, _language string, _origin string, _tokens bigint, _print bigint"
    rows = [(k, "d", "l", f"s{k}", 10**13, k) for k in range(3)]
    counted = spark.createDataFrame(rows, schema)
    found = mixing.budgets(counted, {"origin": {"s0": 10**6, "s1": 10**6}}, 0.5, 2)
    assert {r["_origin"]: r["budget"] for r in found.collect()} == {
        "s0": 15 * 10**12 * 10**6 // (2 * 10**6 + 1) + 0,
        "s1": 15 * 10**12 * 2 * 10**6 // (2 * 10**6 + 1) - 15 * 10**12 * 10**6 // (2 * 10**6 + 1),
        "s2": 15 * 10**12 - 15 * 10**12 * 2 * 10**6 // (2 * 10**6 + 1),
    }
