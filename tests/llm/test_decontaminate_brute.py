"""Decontamination against the plain edit distance of every item to every substring."""

import random

import pytest

from ledgerloom.llm import decontaminate as dc


def plain(item, text, budget):
    """(least distance to a substring, the first place after one that has it), row by row of the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        above, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != t)))
    least = min(row)
    return (least, row.index(least)) if least <= budget else None


def edited(rng, text, n, letters):
    for _ in range(n):
        i = rng.randrange(len(text) + 1)
        kind = rng.randrange(3)
        text = text[:i] + (rng.choice(letters) if kind else "") + text[i + (kind != 1) :]
    return text


def made(seed, letters):
    """Items and texts that hold some of them with no, few or too many edits, next to each other or cut off."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    items = [" ".join(word() for _ in range(rng.randrange(4, 14))) for _ in range(8)]
    items += [items[0], items[1][:-2] + "q"]
    texts = ["", "x", items[0], items[0][1:], items[2] + items[2]]
    for _ in range(150):
        parts = [" ".join(word() for _ in range(rng.randrange(4)))]
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)
            parts += [edited(rng, item, rng.randrange(int(len(item) * 0.08) + 3), letters), word()]
        texts.append("".join(rng.choice(["", " "]) + p for p in parts))
    return items, texts


@pytest.mark.parametrize("seed, letters", [(1, "abcdefghij"), (2, "ab"), (3, "aéß日😀"), (4, "abcd")])
def test_every_item_and_text(spark, seed, letters):
    items, texts = made(seed, letters)
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[2]), (7, texts[2]), (900, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "  ")], "item_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance, r.stop) for r in dc.decontaminate(docs, bench, block=120).collect()), key=repr)
    want = []
    for i, t in [*enumerate(texts), (None, texts[2]), (7, texts[2])]:
        for j, item in enumerate(items):
            item, text = dc.normal(item), dc.normal(t)
            if hit := plain(item, text, int(len(item) * dc.RATE)):
                want.append((i, j, *hit))
    assert got == sorted(want, key=repr) and len(want) > 100


def test_a_long_text(spark):
    item = " ".join(f"word{i}" for i in range(40))
    text = "lorem ipsum " * 40_000 + item.replace("word7 ", "ward7 ") + " dolor" * 40_000
    got = dc.decontaminate(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(0, item)], "item_id bigint, text string")).collect()
    assert [(r.distance, r.stop) for r in got] == [(1, 12 * 40_000 + len(item))]
