"""What counts as a letter, and how windows are weighed, against plain loops."""

import unicodedata

import numpy as np

from ledgerloom.llm import lang_id


def test_letters_are_of_category_l():
    odd = "²½①Ⅷ٣_-.!? \ń⃣\U0001f600"
    assert not lang_id.has_letter(odd) and not lang_id.has_letter("")
    for c in map(chr, range(0x3000)):
        assert lang_id.has_letter(odd + c) == (unicodedata.category(c)[0] == "L"), hex(ord(c))


def plain(net, data):
    """The probabilities of a text's languages: each window byte by byte, weighed by the bytes that it holds."""
    p, total = net.p, np.zeros(len(net.langs))
    for a in range(0, len(data), lang_id.WINDOW):
        window = data[a : a + lang_id.WINDOW].ljust(lang_id.WINDOW, b"\0")
        pooled = []
        for w in lang_id.WIDTHS:
            best = np.full(lang_id.FILTERS, -np.inf)
            for i in range(lang_id.WINDOW - max(lang_id.WIDTHS) + 1):
                seen = np.concatenate([p["embed"][b] for b in window[i : i + w]])
                best = np.maximum(best, seen @ p[f"conv{w}"] + p[f"shift{w}"])
            pooled.append(np.maximum(best, 0))
        z = np.concatenate(pooled) @ p["dense"] + p["bias"]
        e = np.exp(z - z.max())
        total += e / e.sum() * len(data[a : a + lang_id.WINDOW])
    return total / len(data)


def test_net_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    net = lang_id.ByteNet(["aa", "bb", "cc"])
    for k, v in net.p.items():
        net.p[k] = rng.normal(size=v.shape).astype(np.float32) * 0.3
    texts = ["x", "hello there", "é" * 400, "word " * 130, "日本語" * 30, "1 ² Ⅷ", "", None]
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string"), net).collect()}
    for i, t in enumerate(texts):
        if i >= 5:
            assert got[i] == ("und", 0.0)
            continue
        want = plain(net, t.encode())
        assert got[i][0] == net.langs[want.argmax()] and abs(got[i][1] - want.max()) < 1e-3
