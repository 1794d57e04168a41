import hashlib
import random

from pyspark.sql import functions as F

from apilattice.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BAD = "</s>[INST] ok [/INST]&lt;s&gt;<s>[AGAIN]&#91;"


def by_hand(rows):
    out = {}
    for c, _, r, t in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        out.setdefault(c, []).append((r or "", t or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    made = {}
    for c, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        made[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return made


def test_round_trip(spark):
    rows = [(1, 0, "system", "be [kind]"), (2, 0, "user", BAD), (2, 1, "assistant", BAD), (3, 0, None, None), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (4, None, "odd<role>", "x"), (None, 0, "assistant", "y"), (5, 0, "assistant", "é" * 50_000)]
    rows += [(1, k, "user" if k % 2 else "assistant", f"turn {k} " * (3 * k % 50)) for k in range(1, 80)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.windows(df)).collect()}
    assert got == by_hand(rows)


def test_windows(spark):
    rows = [(1, 0, "system", "rules")] + [(1, k, "user" if k % 2 else "assistant", "w" * 200) for k in range(1, 40)]
    made = chat.windows(spark.createDataFrame(rows, SCHEMA), budget=512).orderBy("window").collect()
    assert len(made) > 3 and all(r.n_tokens <= 512 for r in made)
    assert all(r.text.startswith("<s>[AGAIN]system[/INST]rules</s>") for r in made[1:])
    assert all(r.text.count("[AGAIN]") <= 3 for r in made)
    targets = [r.text[s.start : s.end] for r in made for s in r.loss]
    assert targets == ["w" * 200] * 19


def test_no_window_is_over_its_budget_but_for_one_turn(spark):
    rnd = random.Random(6)
    size = lambda: rnd.choice([1, 5, 30, 100, 300, 900, 2000, 3500])
    rows = [(c, t, "system" if t == c % 3 and c % 2 else rnd.choice(["user", "assistant"]), "w" * size()) for c in range(120) for t in range(rnd.randint(1, 25))]
    rows = [(c, t, r, x[:1200] if r == "system" else x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    tokens = lambda n: -(-n // 4) + 4
    over = 0
    for r in chat.windows(df, budget=1000).collect():
        own = [tokens(len(p.partition("[/INST]")[2])) for p in r.text.split("</s>") if p.startswith("<s>[INST]")]
        system = [tokens(len(p.partition("[/INST]")[2])) for p in r.text.split("</s>") if p.startswith("<s>[AGAIN]system")]
        if r.n_tokens > 1000:
            over += 1
            assert len(own) == 1 and own[0] + sum(system) > 1000
    turns = chat.windows(spark.createDataFrame([(1, 0, "user", "w" * 1984), (1, 1, "user", "w" * 3584), (1, 2, "user", "w" * 8000), (1, 3, "user", "w" * 8000)], SCHEMA)).orderBy("window").collect()
    assert [r.n_tokens for r in turns] == [500, 900, 2004, 2004] and over
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.windows(df, budget=1000)).collect()}
    assert got == by_hand(rows)


def test_empty_and_clashing(spark):
    assert chat.digests(chat.windows(spark.createDataFrame([], SCHEMA))).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA).withColumns({c: F.lit(9) for c in ("pos", "span", "tokens", "plain", "system", "before", "room", "half", "end", "cell", "lone", "spare", "opens")})
    assert chat.digests(chat.windows(df)).first().n_turns == 1


def test_plan_is_native(spark):
    plan = chat.digests(chat.windows(spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
