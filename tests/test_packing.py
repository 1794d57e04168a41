import random

import pytest

from apilattice.operators import packing


def plain(types, edges, budget, reserve=100):
    """The loop that packing stands for."""
    out = []
    for package in sorted({p for p, *_ in types}):
        rows = sorted((place, name, chars) for p, name, place, chars in types if p == package)
        cost = {name: chars for _, name, chars in rows}
        seen, used = [], 0
        for _, name, _ in rows:
            refs = sorted({b for p, a, b in edges if p == package and a == name})
            group = [n for n in dict.fromkeys([name, *refs]) if n in cost and n not in seen]
            size = sum(cost[n] for n in group)
            if group and seen and used + size > budget - reserve:
                break
            seen, used = seen + group, used + size
        out += [(package, n, k + 1, cost[n]) for k, n in enumerate(seen)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    types = [(p, f"t{k}", rnd.randint(0, 6), rnd.choice([0, 10, 50, 200, 900])) for p in "abcd" for k in range(rnd.randint(1, 25))]
    edges = [(p, f"t{rnd.randint(0, 25)}", f"t{rnd.randint(0, 27)}") for p in "abce" for _ in range(30)]
    df, refs = spark.createDataFrame(types, "package_id string, name string, place int, chars bigint"), spark.createDataFrame(edges, "package_id string, src string, dst string")
    for budget in (50, 300, 1500, 100_000):
        packed = packing.pack_types(df, refs, budget)
        assert sorted(map(tuple, packed.collect())) == sorted(plain(types, edges, budget))
    assert "Python" not in packed._jdf.queryExecution().toString()


def loaded(files, budget, limit):
    """The loop that a load plan stands for, over (id, size) in order."""
    out, left = [], budget
    for k, size in files:
        if left <= packing.OVERHEAD:
            break
        chars = min(size, limit, left - packing.OVERHEAD)
        if chars > 0:
            out.append((k, chars, chars // 4, chars < size))
            left -= chars + packing.OVERHEAD
    return out


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_load_plan_dealt_to_parts_equals_the_loop(spark, parts):
    rnd = random.Random(parts)
    rows = [(lang, k, rnd.choice([0, 1, 40, 51, 300, 2000])) for lang in "ab" for k in range(rnd.randint(100, 400))]
    files = spark.createDataFrame([*rows, ("c", 0, 0), ("c", 1, None)], "lang string, id int, size bigint")
    for budget in (0, 50, 51, 1000, 20_000, 10**7):
        plan = packing.load_plan(files, ["id"], budget=budget, limit=500, by=["lang"], parts=parts).collect()
        for lang in "ab":
            got = [(r.id, r.chars, r.est_tokens, r.truncated) for r in sorted(plan, key=lambda r: r.ord) if r.lang == lang]
            assert got == loaded([(k, size) for at, k, size in rows if at == lang], budget, 500)
        assert not [r for r in plan if r.lang == "c"]
