"""Decontamination against a loop over all windows of all documents and items."""

import random

import regex
from pyspark.sql import functions as F

from weftline.llm import templates as t


def tokens(text):
    if regex.search(r"[0-9%$€£°]", text):
        text = regex.sub(r"[0-9][0-9ꞏ]*", lambda m: f" 0{m[0]} ", regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "ꞏ", text))
        for sign, name in t.SIGNS.items():
            text = text.replace(sign, f" 1{name} ")
    text = regex.sub(r"""(?<=[\p{L}0-9,;:)'"’] {1,3})\p{Lu}\p{Ll}+(?![\p{L}0-9])""", lambda m: f" 2{m[0]} ", text)
    text = regex.sub(r"(?<![\p{L}0-9])\p{Lu}\p{Ll}+(?![\p{L}0-9])", lambda m: f"3{m[0]}", text)
    return [x for x in regex.split(r"[^\p{L}0-9]+", text.lower()) if x]


def value(x):
    return x[1:] if x[0] in "0123" else x


def form(f, x, before):
    unit = x in t.UNITS and before and before[0] == "0"
    if f == 1:
        if x[0] in "012":
            return x[0]
        if x[0] == "3":
            return "0" if value(x) in t.SPELLED else "2"
        spelled = before and before.lstrip("3") in t.SPELLED
        return "0" if x in t.SPELLED else "1" if unit or (x in t.UNITS and spelled) else x
    if x[0] in "01" or (x[0] == "2" and f == 0):
        return x[0]
    unit = unit or (f == 2 and value(x) in t.UNITS and before and before[0] == "0")
    return "1" if unit else value(x) if x[0] in "23" else x


def windows(raw, size, f, at):
    return tuple(form(f, raw[i], raw[i - 1] if i else None) for i in range(at, at + size))


def by_hand(docs, items):
    out = []
    for item, text in items:
        raw = tokens(text or "")
        n, size = len(raw), min(t.WINDOW, len(raw))
        if not n:
            continue
        total = n - size + 1
        theirs = {}
        plain_total = [0, 0, 0]
        for at in range(total):
            first = windows(raw, size, 0, at)
            for f in range(3):
                toks = windows(raw, size, f, at)
                exact = n < t.LEAST or 2 * sum(x not in ("0", "1", "2") for x in toks) < size
                plain_total[f] += not exact
                if f == 0 or toks != first:
                    theirs.setdefault(toks, []).append((at, f, exact))
        for doc, body in docs:
            own = tokens(body or "")
            best = {}
            for p in range(len(own) - size + 1):
                for g in range(3):
                    toks = windows(own, size, g, p)
                    for at, f, exact in theirs.get(toks, []):
                        pairs = [(k, value(raw[at + i]), value(own[p + i])) for i, k in enumerate(toks)]
                        if not exact or all(a == b for _, a, b in pairs):
                            m = (max(f, g), exact, [x for x in pairs if x[0] in ("0", "1", "2")])
                            best[p - at, p] = min(m, best.get((p - at, p), m))
            for delta in {d for d, _ in best}:
                judged = []
                for judge in range(3):
                    held = {p: m for (d, p), m in best.items() if d == delta and m[0] <= judge}
                    plain = sum(not m[1] for m in held.values())
                    slots = {s for m in held.values() for s in m[2]}
                    of = lambda k, slots=slots: [s for s in slots if s[0] == k]
                    agree = all(len({s[1] for s in of(k)}) == len(of(k)) for k in "12") and len({s[2] for s in of("2")}) == len(of("2"))
                    enough = len(held) >= min(t.RUN, total) or plain >= max(1, min(t.RUN, plain_total[judge]))
                    if held and agree and enough:
                        changed = sum(s[1] != s[2] for s in slots)
                        judged.append((len(held), -judge, changed, min(held), max(held) + size))
                if judged:
                    n_, _, changed, start, stop = max(judged)
                    out.append((doc, item, "reparameterised" if changed else "verbatim", n_, changed, start, stop))
    return sorted(out)


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("slots", F.lit("clash"))
    rows = t.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted((r.doc_id, r.item_id, r.kind, r.windows, r.changed, r.start, r.stop) for r in rows)


def test_all_windows(spark):
    rng = random.Random(2)
    words = "the a train leaves with apples and walks to market on three seven day river sells many baskets pears km hours of for each pens dollars".split()
    names = "Alice Bob Carol Dave Erin Boston Paris".split()

    def sentence(n):
        out = []
        for _ in range(n):
            x = rng.random()
            out.append(rng.choice(names) if x < 0.12 else f"{rng.choice([3, 5, 12, '1.5'])} {rng.choice(['km', 'dollars', 'pens', '%'])}" if x < 0.24 else rng.choice(words))
        text = " ".join(out) + rng.choice([".", "?", ""])
        return text[0].upper() + text[1:] if rng.random() < 0.5 else text

    items = [(i, " ".join(sentence(rng.choice([3, 6, 9, 14])) for _ in range(rng.choice([1, 2])))) for i in range(14)] + [(50, None), (51, ""), (52, "5"), (53, "What is 17?")]
    change = [lambda x: x, str.lower, str.upper, str.title, lambda x: x.replace("Alice", "Zoe"), lambda x: x.replace("5", "8"), lambda x: x.replace("Bob", "Alice"), lambda x: x.replace("three", "4"), lambda x: x.replace("km", "miles"), lambda x: x[: len(x) * 2 // 3]]
    docs = []
    for _, text in items[:14] + items[-1:]:
        for c in change:
            docs.append((len(docs), rng.choice(["", sentence(12) + " ", sentence(5) + '\n"']) + c(text) + rng.choice(["", " " + sentence(9)])))
    docs += [(900, None), (901, ""), (902, sentence(3000) + " " + items[3][1])]
    want = by_hand(docs, items)
    assert len({x[0] for x in want}) > 60 and {x[2] for x in want} == {"verbatim", "reparameterised"}
    assert found(spark, docs, items) == want


def test_letter_case_and_equal_numbers(spark):
    item = "Alice has 5 pens for 5 dollars each and Bob walks 7 miles to the market with Carol before the shop closes"
    docs = [(0, item), (1, item.lower()), (2, item.upper()), (3, item.title()), (4, item.replace("5 pens for 5", "6 pens for 9")), (5, item.replace("Carol", "Bob")), (6, item.lower().replace("alice", "zoe"))]
    got = {(r[0], r[2]) for r in found(spark, docs, [(1, item)])}
    assert got == {(0, "verbatim"), (1, "verbatim"), (2, "verbatim"), (3, "verbatim"), (4, "reparameterised"), (6, "verbatim")}
    assert found(spark, docs, [(1, item.lower())])[0][0] == 0
