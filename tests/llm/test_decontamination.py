"""Cases in which less than the whole job once passed unnoticed."""

import math
import random
from collections import Counter


def leaked(docs, items, block=64):
    """(doc, item) pairs that are copies, and those that a large cosine may add, by comparing every passage with every piece of every item."""
    split = {d: t.split() for d, t in docs}
    blocks = [set(w[a : a + block]) for w in split.values() for a in range(0, len(w), block)]
    df = Counter(word for b in blocks for word in b)
    idf = lambda word: math.log((len(blocks) + 1) / (df[word] + 1)) + 0.05

    def common(item, weight, passage):
        best = [0.0] * (len(passage) + 1)
        for word, w in zip(item, weight):
            before = 0.0
            for j, other in enumerate(passage, 1):
                best[j], before = max(best[j], best[j - 1], before + w if word == other else 0.0), best[j]
        return best[-1]

    out, maybe = set(), set()
    pieces = [(i, w[a : a + block]) for i, text in items if (w := text.split()) for a in {*range(0, len(w) - block, block), max(len(w) - block, 0)}]
    for d, w in split.items():
        for a in range(0, max(len(w) - block, 1), block):
            passage = w[a : a + 2 * block]
            for i, item in pieces:
                weight = [idf(x) for x in item]
                share = common(item, weight, passage) / sum(weight)
                tail = item[-max(4, len(item) // 4) :]
                answer = common(tail, [1.0] * len(tail), passage) >= 0.75 * len(tail)
                if share >= 0.65 or (share >= 0.55 and answer):
                    out.add((d, i))
                elif share >= 0.40 and answer:
                    maybe.add((d, i))
    return out, maybe


def test_short_items_in_passages_of_other_items(spark):
    """A short item among words of other items has a small cosine with its passage, and is found all the same."""
    from corvane.llm.decontaminate import contaminated

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(400)]
    items = [(i, " ".join(rng.sample(vocabulary, rng.randint(12, 20)))) for i in range(60)]
    docs = []
    for d in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([40, 130, 300, 700]))]
        for _, item in rng.sample(items, 2) if d % 3 else []:
            at = rng.randrange(len(text))
            text[at:at] = [w if rng.random() > 0.2 else rng.choice(vocabulary) for w in item.split()]
        docs.append((d, " ".join(text)))
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want, maybe = leaked(docs, items)
    assert len(want) > 40 and want <= {(r["doc_id"], r["item_id"]) for r in found} <= want | maybe
    assert all((r["doc_id"], r["item_id"]) in want or r["cosine"] >= 0.75 for r in found)


def test_long_items_clashing_columns_and_nulls(spark):
    """Every piece of a long item is searched, its end too; columns named like results, null ids and megabytes of text do no harm."""
    from corvane.llm.decontaminate import contaminated

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    item = [word() for _ in range(90)]
    filler = [word() for _ in range(300)]
    docs = [(1, " ".join(filler[:50] + item[:64])), (2, " ".join(item[64:] + filler[50:90])), (3, " ".join(filler)), (None, " ".join(item)), (4, None), (5, " ".join(filler * 900 + item + filler * 10)), (1, " ".join(item))]
    frame = spark.createDataFrame([(*d, "x", 0.5) for d in docs], "doc_id long, text string, item_id string, cosine double")
    found = contaminated(frame, spark.createDataFrame([(7, " ".join(item)), (8, None), (None, "")], "item_id long, text string"))
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in found.collect()) == [("1", 7), ("5", 7), ("None", 7)]
    tail = [("two", " ".join(item[30:])), ("one", " ".join(filler[:9] + item[26:]))]
    found = contaminated(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(tail)], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"] for r in found.collect()} == {0, 1}


def test_paraphrases_are_found(spark):
    """Of items with up to 30 of 100 words replaced, nine in ten are found; documents without an item are left alone."""
    from corvane.llm.decontaminate import contaminated

    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 60)))) for i in range(200)]
    docs = []
    for d in range(400):
        text = rng.choices(vocabulary, k=rng.randint(50, 400))
        if d < 200:
            at, share = rng.randrange(len(text)), rng.choice([0.0, 0.1, 0.2, 0.3])
            text[at:at] = [w if rng.random() >= share else rng.choice(vocabulary) for w in items[d][1].split()]
        docs.append((d, " ".join(text)))
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((d, d) in found for d in range(200)) >= 180 and all(d == i for d, i in found)


def test_decontamination(spark, docs, empty):
    from corvane.llm.decontaminate import contaminated

    rng = random.Random(4)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500, "some start " + item.upper() + " end"), (501, item[: len(item) // 5])], "doc_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(extra, bench).collect()} == {(500, 1)}
    assert contaminated(empty, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
