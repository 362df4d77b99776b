"""Quotation linking against a plain walk through each conversation."""

import random

import pytest

from lakestrata.llm import quotes


def test_parse():
    text = "> > older\n> newer\n> more\n>\n> end\n\nMy own.\n  >aside\nBye."
    left, found = quotes.parse(text)
    assert left == "\nMy own.\nBye.".strip("\n")
    assert found == [(2, "older"), (1, "newer\nmore\n\nend"), (1, "aside")]
    assert quotes.parse("a > b\n\n\n\nc") == ("a > b\n\n\n\nc", [])
    assert quotes.parse(">\n> \nx") == (">\n> \nx", [])
    assert quotes.normal("  Hello,\n  World!! ") == "hello, world"


def brute(rows):
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    out = []
    for conv, messages in by_conv.items():
        messages.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", quotes_digest(r[3])))
        said, depth = [], {}
        for position, (_, turn, role, text) in enumerate(messages, 1):
            left, found = quotes.parse(text or "")
            sources = []
            for nth, (level, passage) in enumerate(found):
                n = quotes.normal(passage)
                at = max((i for i, s in enumerate(said, 1) if n and n in s), default=None)
                if at is not None:
                    sources.append((level, nth, at))
            reply = min(sources)[2] if sources else position - 1 or None
            depth[position] = 0 if reply is None else depth[reply] + 1
            out.append((conv, turn, role, position, reply, depth[position], len(found), len(sources), left))
            said.append(set(quotes.paragraphs(left)))
    return sorted(out, key=str)


def quotes_digest(text):
    import hashlib

    return hashlib.sha256((text or "").encode()).hexdigest()


COLUMNS = ["conv_id", "turn", "role", "position", "reply_to", "depth", "n_quotes", "n_linked", "text"]


def own(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    return sorted(map(tuple, quotes.link(df)[0].select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(rnd.randint(1, 14)):
            lines = [f"{rnd.choice(['Yes', 'No', 'Maybe'])} {rnd.randint(0, 9)}." for _ in range(rnd.randint(0, 3))]
            for _ in range(rnd.randint(0, 2)):
                if texts:
                    source = rnd.choice(texts).split("\n")
                    lines = [*(rnd.choice([">", "> ", ">> "]) + s.upper() for s in source), "", *lines]
            texts.append("\n".join(lines))
            rows.append((conv, turn if turn % 6 else 0, rnd.choice(["user", "assistant"]), texts[-1]))
    rows += [(None, 1, "user", "hi"), (None, 2, None, "> hi"), (50, None, "user", None), (50, 3, "user", ""), (50, 3, "user", "")]
    rows += [(51, 0, "user", "x " * 50_000), (51, 1, "user", "> " + "x " * 50_000)]
    assert own(spark, rows) == brute(rows)


def test_empty_and_order(spark):
    assert own(spark, []) == []
    rows = [(1, 0, "a", "first"), (1, 1, "b", "second"), (1, 2, "c", "> first\nthird"), (1, 3, "d", "> second\nfourth")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages, passages = quotes.link(df)
    assert [r.text for r in quotes.conversations(messages).orderBy("conv_id", "path").collect()] == ["first", "second", "fourth", "third"]
    assert sorted((r.position, r.source) for r in passages.collect()) == [(3, 1), (4, 2)]


def reply_order(rows):
    """Ranks of (conv, position, reply_to) by a walk over each conversation's tree."""
    answers, ranks = {}, {}
    for conv, position, reply in sorted(rows, key=str):
        answers.setdefault((conv, reply), []).append(position)
    for conv in {r[0] for r in rows}:
        waiting, rank = [1], 0
        while waiting:
            at = waiting.pop()
            ranks[conv, at] = rank = rank + 1
            waiting += sorted(answers.get((conv, at), []), reverse=True)
    return ranks


@pytest.mark.parametrize("span", [2, 16])
def test_reply_order(spark, monkeypatch, span):
    monkeypatch.setattr(quotes, "SPAN", span)
    rnd = random.Random(span)
    rows = [(conv, t, "u", (f"> m{rnd.randrange(t)}\n" if t and rnd.random() < p else "") + f"m{t}") for conv, size, p in ((1, 40, 0.3), (2, 25, 1.0), (3, 9, 0.0), (None, 30, 0.6)) for t in range(size)]
    rows += [(5, t, "u", (f"> m{t // 700}\n" if t % 500 == 499 else "") + f"m{t}") for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.link(df)[0].collect()
    want = reply_order([(r.conv_id, r.position, r.reply_to) for r in got])
    assert {(r.conv_id, r.position): r.rank for r in got} == want
    depth = {}
    for r in sorted(got, key=lambda r: r.position):
        depth[r.conv_id, r.position] = 0 if r.reply_to is None else depth[r.conv_id, r.reply_to] + 1
    assert {(r.conv_id, r.position): r.depth for r in got} == depth
