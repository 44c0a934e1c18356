import hashlib
import os
import random
from collections import Counter

import pytest

from gristmill.llm import alignment

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(alignment.BYTE_FILE), reason="no tokenizers")
#: Texts that try the cuts: runs of white space of all kinds, controls, special tokens, bytes of no piece.
HARD = ["a", " ", "  ", "\n", "a ", " a", "a\r\nb\r\n", "x\t\ty  z \n\n w", "it's  'll we'll", "a　b c  d", "a\x1c b\x1d\x1e c", "a\x85 b  c", "<|endoftext|> a </s><s> <0x41> <unk>", "日本語 テキスト\n中文", "😀 é ​ z", "\x00 \x00", "a▁b c", "▁", "1 234,5 678", ");\r\n\r\n}", "trailing \t", "ſ's 'S", "a" * 300, "fi ﬁ ½ Ⅷ"]


def whole(tools):
    """Both tokenizers over whole texts, as they come."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(tools.bytes_json)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=tools.piece_model)
    return a, b


def brute(rows, tools):
    a, b = whole(tools)
    docs, count = [], Counter()
    for doc, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(tools.bytes_a[i] for i in ids_a) != raw or b"".join(tools.bytes_b[i] for i in ids_b) != raw:
            ids_a = ids_b = []
        spans = []
        for ids, of in ((ids_a, tools.bytes_a), (ids_b, tools.bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of[i]), i))
                at = own[-1][1]
            spans.append(own)
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ";".join("|".join(",".join(str(i) for s, _, i in own if lo <= s < hi) for own in spans) for lo, hi in zip([0, *cuts], cuts))
        docs.append((doc, ids_a, ids_b, len(cuts), links, groups))
        count.update(set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(((d, len(x), len(y), g, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(t.encode()).hexdigest() if x else "", t) for d, x, y, g, links, t in docs), key=str)


@pytest.fixture(scope="module")
def tools():
    return alignment.Tokenizers()


def test_against_whole_texts(spark, tools):
    rng = random.Random(4)
    rows = [*enumerate(HARD), (None, None), (None, ""), (3, "again  and\nagain"), (3, "again  and\nagain")]
    rows += [(100 + i, "".join(rng.choice([*HARD, " ", "\n", "word", "naïve", "e", " the", "\r"]) for _ in range(rng.randrange(1, 14)))) for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in alignment.align(docs, tools, groups=True, chunk_size=900).collect()), key=str)
    assert got == brute(rows, tools)


def test_cuts(tools):
    assert " " in tools.cuts and "\n" in tools.cuts and "\r" not in tools.cuts  # pieces such as `;\r` go over it
    with pytest.raises(ValueError, match="over a space"):
        alignment.verified_cuts([b"a b"], [])


def test_long_texts_are_cut_in_slices(tools, monkeypatch):
    text = " ".join(HARD) * 9
    want = [s for part in tools.segments(text) for s in part]
    monkeypatch.setattr(alignment, "SLICE", 20)
    parts = list(tools.segments(text))
    assert len(parts) > 20 and [s for part in parts for s in part] == want and "".join(want) == " " + text


def test_no_rows(spark, tools):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string, chunk int"), tools).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query(spark, tools):
    from gristmill.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    small = {r[0] for r in rows if len(r[1] or "") < 3000}  # the others take the plain version too long
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_alignment"](spark, DIR).collect()}
    assert len(got) == len(rows)
    a, b = whole(tools)
    assert all(got[d][:2] == ((len(a.encode(" " + t).ids), len(b.encode(t))) if t else (0, 0)) for d, t in rows)
    assert all(got[d][6] == x[7] and got[d][2:4] == x[3:5] for x in brute([r for r in rows if r[0] in small], tools) for d in [x[0]])
