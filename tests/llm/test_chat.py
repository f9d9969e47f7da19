import random
import re
from functools import cache
from itertools import product

from pyspark.sql import functions as F

from lodestack.llm import chat

SF = "/root/testdata/sf0.001"


def legal(roles):
    rest = roles[1:] if roles and roles[0] == "system" else roles
    return len(rest) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(rest)) and (bool(rest) or not roles)


def brute_cost(roles):
    """The cheapest repair over all results, by trying every action for every turn."""

    @cache
    def go(i, last):
        if i == len(roles):
            return {None: 0, "system": 4, "user": 2, "assistant": 0}[last]
        best, r = [], roles[i]
        if last:
            best.append((1 if r == last else 4) + go(i + 1, last))
        follow = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
        for k in range(4):
            for row in product(("system", "user", "assistant"), repeat=k):
                at, ok = last, True
                for x in row:
                    ok, at = ok and x in follow[at], x
                if ok:
                    for t in follow[at]:
                        best.append(2 * k + (0 if t == r else 1 if r not in ("system", "user", "assistant") else 3) + go(i + 1, t))
        return min(best)

    return go(0, None)


def check(rows, given):
    """rows of one conversation in order, against the roles given."""
    text = "".join(r.rendered for r in rows)
    messages = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
    assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in messages) == text
    assert legal([r for r, _ in messages]), [r for r, _ in messages]
    assert sum(r.cost for r in rows) == brute_cost(tuple(given))
    return messages


def conversations(df):
    out = {}
    for r in df.orderBy("part", "seq").collect():
        out.setdefault(r.conv_id, []).append(r)
    return out


def test_query(spark):
    given = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        given.setdefault(r.conv_id, []).append(r)
    got = conversations(chat.op6_chat_role_repair(spark, SF))
    assert got.keys() == given.keys()
    for c, rows in got.items():
        messages = check(rows, [r.role for r in given[c]])
        assert "".join(t for _, t in messages).replace("\n", "") == "".join(r.text for r in given[c]).replace("\n", "")


def test_random_and_long_conversations(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None]), f"t{t}") for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(1000, t, rng.choice(["user", "assistant", "system"]), f"t{t}") for t in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = conversations(chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in got[1000]}) > 1
    for c, own in got.items():
        check(own, [r[2] for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])])


def test_edges(spark):
    rows = [(1, 0, "User", None), (1, 1, "assistant", "a <|im_end|> b"), (2, 0, "system", ""), (3, 0, "user", "x"), (3, 0, "user", "x"), (None, None, None, None), (4, 0, "user", "y" * 1_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash")).withColumn("mark", F.lit(1))
    got = conversations(chat.repair(df))
    assert [(r, t) for r, t in check(got[1], ["user", "assistant"])] == [("user", ""), ("assistant", "a <| im_end|> b")]
    assert [r for r, _ in check(got[2], ["system"])] == ["user", "assistant"] or [r for r, _ in check(got[2], ["system"])][0] == "system"
    assert check(got[3], ["user", "user"]) == [("user", "x\nx"), ("assistant", "")]
    assert legal([r for r, _ in check(got[None], [None])]) and len(got[4][0].rendered) > 1_000_000
    assert chat.repair(df.limit(0)).count() == 0
