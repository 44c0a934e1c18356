import random
from itertools import permutations

from gristmill.llm import interplay

ROWS = "doc_id long, text string, source string, part int"


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    ids = {}
    for d, text, *_ in rows:
        ids.setdefault(text or "", []).append(float("inf") if d is None else d)

    def fails(d, text):
        words = text.split(" ") if text else []
        own = float("inf") if d is None else d
        return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": min(ids[text]) < own}

    docs = [(s or "", d, fails(d, t or "")) for d, t, s, _ in rows]
    out = {}
    for part in {p for p, *_ in docs}:
        own = [(d, f) for p, d, f in docs if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                lost = [d for d, f in left if f[x]]
                failing = sum(f[x] for _, f in own)
                left = [(d, f) for d, f in left if not f[x]]
                out[part, "".join(order), step] = [len(left), len(lost), failing - len(lost), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(d in good for d in lost), sum(d in toxic for d in lost)]
                total[x] += len(lost)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_swaps_visit_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for i in interplay.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_against_every_order_applied(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "Cc", "#"] + [f"w{i}" for i in range(k)]) for _ in range(n)) for n in (5, 199, 200, 201, 260) for k in (1, 60, 2000, 20000)]
    rows = [(i, rng.choice([*texts, None, ""]), rng.choice(["x", "y", "", None, "é"]), i) for i in range(300)]
    rows += [(None, texts[0], "x", 1), (None, texts[0], "y", 1), (5, texts[1], "x", 1), (5, texts[1], "x", 1), (5, texts[1], "y", 1), (6, "Z" * 3 + "z" * 147, "z", 1), (7, "Z" * 3 + "z" * 148, "z", 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (None, 1, 1)]
    found = interplay.audit(spark.createDataFrame(rows, ROWS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in found}
    assert len(found) == len(got) == 600 * 5 and got == brute(rows, labels)


def test_no_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert interplay.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
