import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from contexture.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SAID = "</s>[INST] ok [/INST]\\ <<SYS>> <|end|> \\["


def turns():
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", "bye"),
        (2, 0, "user", "hello"), (2, 1, "assistant", "hi"),
        (3, 0, "user", "hello"), (3, 1, "assistant", "hi"),
        (4, 1, "assistant", None), (4, 0, None, "no role"), (4, None, "system", ""),
        (5, 0, "tool|x<", SAID), (5, 1, "assistant", SAID), (5, 1, "assistant", SAID),
        (None, 0, "user", "null id"), (6, 0, "user", "x" * 200_000),
    ]
    rows += [(100 + k, t, ("user", "assistant")[t % 2], f"same {t}" if t < 2 else f"{k} {t}") for k in range(50) for t in range(4)]
    return rows


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(
            ((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv)
        )
        said = "".join(x for *_, r, x in own if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        size = sum(len("".join(chat.format_turn(r, x))) for *_, r, x in own)
        out.append((conv, len(own), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), size))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece_chars", [1 << 16, 60, 1])
@pytest.mark.parametrize("pack_chars", [1 << 16, 60])
def test_conversations_come_back(spark, pack_chars, piece_chars):
    own = chat.pieces(spark.createDataFrame(turns(), SCHEMA).repartition(3), piece_chars)
    found = chat.digests(chat.packed(own, pack_chars), own)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(turns())


def test_shared_turns_are_written_once_with_their_attention(spark):
    own = chat.pieces(spark.createDataFrame(turns(), SCHEMA).where("conv_id >= 100"))
    packs = chat.packed(own.coalesce(1)).collect()
    assert sum(pack["text"].count("same 0") for pack in packs) == len(packs)
    for pack in packs:
        for node in pack["nodes"]:
            way, at = [], node["parent"]
            while at >= 0:
                way.append(pack["nodes"][at])
                at = pack["nodes"][at]["parent"]
            covered = sum(part["end"] - part["begin"] for part in node["attends"])
            assert covered == node["position"] == sum(n["end"] - n["begin"] for n in way)


@given(st.text())
def test_escapes_are_reversible_and_hide_marks(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    for mark in ("[INST]", "[/INST]", "</s>", "<<SYS>>", "<|end|>"):
        assert mark not in hidden.replace("\\\\", "") or "\\" + mark[0] in hidden


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversations_of_all_kinds(spark):
    """Of no id, in copies, with equal turns: the same path for every length."""
    rows = turns() + [(None, t, ("user", "assistant")[t % 2], f"{SAID} {t}") for t in range(1, 3000)]
    rows += [(conv, t // 2, ("user", "assistant")[t % 2], f"ü {t}") for conv in (7, 8) for t in range(400)]
    rows += [(9, t, "assistant", "x" * 1_000) for t in range(1_500)]
    found = chat.formatted(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_long_and_short_conversations_share_their_turns(spark):
    """A conversation goes on behind the packs of those it begins like."""
    begin = [("user", "a shared question"), *(("assistant", f"shared {t}") for t in range(60))]
    convs = {7: begin + [("user", f"{t}") for t in range(300)], 8: begin[:2], 9: begin + [("user", "end")], 10: begin}
    rows = [(conv, t, role, text) for conv, own in convs.items() for t, (role, text) in enumerate(own)]
    own = chat.pieces(spark.createDataFrame(rows, SCHEMA).repartition(4), 500).cache()
    packs = chat.packed(own.coalesce(1), 2_000)
    found = chat.digests(packs, own)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)
    packs = packs.collect()
    assert sum(pack["text"].count("a shared question") for pack in packs) == 1
    assert sum(pack["text"].count("shared 59") for pack in packs) == 1
    ends = {leaf["path"]: (pack, leaf["node"]) for pack in packs for leaf in pack["leaves"]}
    assert max(len(pack["text"]) for pack in packs) < 2_000 and len(packs) > 5
    for pack in packs:
        if pack["above"] != chat.ROOT:
            above, at = ends[pack["above"]]
            assert above["nodes"][at]["position"] + above["nodes"][at]["end"] - above["nodes"][at]["begin"] == pack["start"]
        for node in pack["nodes"]:
            assert node["position"] == pack["start"] + sum(a["end"] - a["begin"] for a in node["attends"])


def test_roles_are_read_from_the_text(spark):
    for role in ("user", "assistant", "system", "", "tool|x<", "a\\b", "|>", "INST"):
        head, body, _ = chat.format_turn(role, SAID)
        assert chat.read_turn(head, body) == (role, SAID)


def test_columns_of_other_names_are_not_read(spark):
    frame = spark.createDataFrame(turns(), SCHEMA).selectExpr("*", "1 AS part", "'x' AS path", "2 AS above")
    found = chat.formatted(frame)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(turns())
