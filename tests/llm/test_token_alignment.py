"""The alignment of two tokenizers against plain loops over whole texts."""

import bisect
import hashlib
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mercadia.llm import token_alignment as A
from mercadia.llm._common import table
from mercadia.llm.queries import QUERIES, TOKENIZER_A, TOKENIZER_B
from tests.llm.cases import documents, empty

ODD = [
    "Hello, world! It's 42.", "  two  blanks ", "tabs\tand\r\nlines\n\n\nmany", "x\n y\n", "\nstart", " \n start", "a▁b c", "中文 字符串没有空格 \U0001f600\U0001f600!", "é è ﬁ ½ — “q”",
    "<|endoftext|> <s></s> <unk> <0x41> a", "  nbsp x 　y", "x" * 400, "word " * 50, "\x00 nul \x1c fs", "a \x85b", "don't 'twas I'll  we've", "ｆｕｌｌ ｗｉｄｔｈ", "é ́x", " ", "\n", "a\nb\nc d", "ends with newline\n", "ends with blank ",
]


@pytest.fixture(scope="module")
def pair():
    with open(TOKENIZER_A, "rb") as a, open(TOKENIZER_B, "rb") as b:
        return A.Pair(a.read(), b.read())


def brute(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    a = Tokenizer.from_file(TOKENIZER_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER_B)
    letters = A._byte_letters()
    a_bytes = {i: bytes(letters[c] for c in e) for e, i in a.get_vocab().items() if i != 50256}
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    counts, out = Counter(), []
    for text in texts:
        sides = []
        for ids, size in ((a.encode(" " + text, add_special_tokens=False).ids, a_bytes), (b.encode(text), b_bytes)) if text else ():
            at, tokens = 0, []
            for i in ids:
                tokens.append((i, at, at := at + len(size[i])))
            sides.append((tokens, b"".join(size[i] for i in ids)))
        if not text or any(joined != (" " + text).encode() for _, joined in sides):
            out.append(None)
            continue
        (ta, _), (tb, _) = sides
        links, j = [], 0
        for x in ta:
            while tb[j][2] <= x[1]:
                j += 1
            k = j
            while k < len(tb) and tb[k][1] < x[2]:
                links.append((x[0], tb[k][0]))
                k += 1
        counts.update(links)
        cuts = sorted({x[2] for x in ta} & {y[2] for y in tb})
        ids = [{c: [] for c in cuts} for _ in sides]
        for own, side in zip(ids, (ta, tb)):
            for i, _, e in side:
                own[cuts[bisect.bisect_left(cuts, e)]].append(str(i))
        groups = [f"{','.join(ids[0][c])}|{','.join(ids[1][c])}" for c in cuts]
        out.append((len(ta), len(tb), len(groups), links, ";".join(groups)))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [none if o is None else (*o[:3], len(o[3]), sum(counts[x] == most[x[1]] for x in o[3]), sum(counts[x] for x in o[3]), o[4]) for o in out]


def found(df, last="groups"):
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", last)
    return [(r["doc_id"], *[r[c] for c in cols]) for r in df.collect()]


def test_units_are_cut_where_both_cut(spark, sf, pair):
    assert pair.cuts
    texts = [t for t in ODD if pair.faithful(t)] + [r.text for r in table(spark, sf, "documents").limit(60).collect() if pair.faithful(r.text)]
    for text in texts:
        tokens = pair.encode(pair.units(text))
        assert [i for a, _ in tokens for i in a] == pair.a.encode(" " + text, add_special_tokens=False).ids, text
        assert [i for _, b in tokens for i in b] == pair.b.encode(text), text
    assert [t for t in ODD if not pair.faithful(t)] == ["a▁b c"]


@pytest.mark.parametrize("shipped", [A.SHIPPED, 20, 0])
def test_odd_texts(spark, shipped):
    rows = list(enumerate(ODD + ["", None, ODD[0], ODD[0] + " more"])) + [(0, ODD[0]), (None, "a null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(found(A.align(docs, TOKENIZER_A, TOKENIZER_B, shipped=shipped)), key=str)
    assert got == sorted([(i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows]))], key=str)


def test_links_of_a_text_that_is_one_unit(spark):
    text = "中文字符串" * 500 + "<>" * 300
    docs = spark.createDataFrame([(1, text), (2, text + " x")], "doc_id long, text string")
    assert sorted(found(A.align(docs, TOKENIZER_A, TOKENIZER_B))) == [(i, *b) for i, b in zip((1, 2), brute([text, text + " x"]))]


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    want = sorted((i, *b[:-1], sha(b[-1])) for (i, _), b in zip(rows, brute([t for _, t in rows])))
    assert sorted(found(QUERIES["op11_token_alignment"](spark, sf), "groups_sha256")) == want


def test_cases(spark):
    assert A.align(empty(spark), TOKENIZER_A, TOKENIZER_B).count() == 0
    got = A.align(documents(spark).withColumn("uid", F.lit(1)).withColumn("unit", F.lit("x")), TOKENIZER_A, TOKENIZER_B)
    texts = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert sorted(found(got), key=str) == sorted([(i, *b) for (i, _), b in zip(texts, brute([t for _, t in texts]))], key=str)
