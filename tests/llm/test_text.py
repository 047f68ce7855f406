"""Toxicity, archives, token counts and surrogates."""

import gzip
import hashlib
import json
import math
import re
import zlib
from collections import defaultdict

import pytest
import regex
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from mercadia.llm import surrogates, token_counts, toxicity, warc
from mercadia.llm._common import new_path, table
from tests.llm.cases import documents, empty, rows
from tests.llm.test_native import low

SF1 = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF1, "documents"), table(spark, SF1, "labels")
    got = toxicity.toxicity(docs, labels)
    pdf = got.join(labels, "doc_id", "left").toPandas()
    assert len(pdf) == docs.count() and pdf.score.between(0, 1).all()
    assert ((pdf.score >= 0.5).astype(int) == pdf.predicted).all()
    assert (pdf.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in pdf.doc_id]).all()
    out = pdf[pdf.held_out & pdf.toxic.notna()]
    rank, pos = out.score.rank(), out.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / pos.sum() / (~pos).sum()
    assert auc > 0.93
    assert out[out.predicted == 1].toxic.mean() > 0.9


def test_toxicity_ignores_held_out_labels_and_other_columns(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    want = rows(toxicity.toxicity(docs, labels))
    assert rows(toxicity.toxicity(docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit("x")), other)) == want


def test_toxicity_cases(spark, sf):
    labels = table(spark, sf, "labels")
    train = table(spark, sf, "documents")
    more = documents(spark).select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text")
    got = toxicity.toxicity(train.select("doc_id", "text").unionByName(more), labels)
    assert got.count() == train.count() + more.count() and got.where("score is null").count() == 0
    assert toxicity.toxicity(documents(spark), labels.limit(0)).select("predicted").distinct().collect()[0][0] == 0
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    again = toxicity.toxicity(documents(spark), spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int"))
    assert again.count() == documents(spark).count()


def brute_toxicity(train, texts, d=toxicity.DISCOUNT, order=toxicity.ORDER, shared=toxicity.SHARED):
    """(mean, top) of each text by the models as the docstring states them, with plain dictionaries."""
    pad = " " * (order - 1)
    plain = lambda t: pad + "".join(w + " " for w in low(t))
    counts = [defaultdict(int), defaultdict(int)]
    for t, y in train:
        p = plain(t)
        for g in {p[i : i + order] for i in range(len(p) - order + 1)}:
            counts[y][g] += 1
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        longer = levels[n + 1]
        if n + 1 == shared + 1:
            longer = [dict.fromkeys({*longer[0], *longer[1]}, 1)] * 2
        below = [defaultdict(int), defaultdict(int)]
        for c in (0, 1):
            for g in longer[c]:
                below[c][g[1:]] += 1
        levels[n] = below
    about = {}
    for n, both in levels.items():
        for c in (0, 1):
            for g, v in both[c].items():
                total, kinds = about.get((c, g[:-1]), (0, 0))
                about[c, g[:-1]] = total + v, kinds + 1

    def p(c, g):
        if not g:
            return 1 / toxicity.CHARACTERS
        total, kinds = about.get((c, g[:-1]), (0, 0))
        below = p(c, g[1:])
        return (max(levels[len(g)][c].get(g, 0) - d, 0) + d * kinds * below) / total if total else below

    out = []
    for t in texts:
        x, words, at = plain(t), [], 0.0
        for i in range(order - 1, len(x)):
            at += math.log(p(1, x[i - order + 1 : i + 1]) / p(0, x[i - order + 1 : i + 1]))
            if x[i] == " ":
                words.append(at)
                at = 0.0
        out.append((sum(words) / max(1, len(x) - order + 1), sum(sorted(words, reverse=True)[: toxicity.TOP]) / toxicity.TOP))
    return out


def test_toxicity_equals_brute_force(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    train = [(r.text, r.toxic) for r in docs.join(labels, "doc_id").where("toxic is not null").collect()]
    train += [("你好世界这是一个没有空格的句子坏人", 1), ("你好世界这是一个没有空格的句子好人", 0)]
    assert len(train) > 50 and {y for _, y in train} == {0, 1}
    made = spark.createDataFrame([(t, y) for t, y in train], "text string, toxic int")
    table_ = toxicity.weights(made)
    texts = [r.text for r in docs.where("length(text) < 3000").limit(60).collect()] + [None, "", " . ", "abcdefghiidiot", "abcdefghithing", "你好世界这是一个没有空格的句子坏人", "你好世界这是一个没有空格的句子好人", "idiot", "ab idiot idiot idiot", "x" * 9 + "idiot", "e" * 5000]
    rows_ = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    want = brute_toxicity(train, texts)
    for model in (toxicity.ship(table_), toxicity.ship(table_, 0)):
        got = {r.n: r for r in toxicity.measure(rows_, model, "n").collect()}
        assert len(got) == len(texts)
        for i, (mean, top) in enumerate(want):
            assert got[i]["__m_mean"] == pytest.approx(mean, abs=2e-5) and got[i]["__m_top"] == pytest.approx(top, abs=2e-4), texts[i]
    mean = [m for m, _ in want]
    at = texts.index("abcdefghiidiot")
    assert mean[at] > mean[at + 1] and mean[at + 2] > mean[at + 3]


def test_toxicity_by_joining_equals_shipping(spark, sf):
    docs, labels = table(spark, sf, "documents").unionByName(documents(spark).select("doc_id", "text", "lang", "source", "n_chars")), table(spark, sf, "labels")
    one, other = (rows(toxicity.score(docs, toxicity.fit(docs, labels, most), "doc_id"), "doc_id", "score") for most in (toxicity.SHIPPED, 0))
    assert [r[0] for r in one] == [r[0] for r in other] and len(one) == docs.count()
    assert [r[1] for r in one] == pytest.approx([r[1] for r in other], abs=1e-6)


def test_stage_columns_may_clash(spark, sf):
    import corpus_pipeline

    labels = table(spark, sf, "labels")
    docs = documents(spark).withColumn("score", F.lit(7)).withColumn("words", F.lit("w")).withColumn("ratio", F.lit(1.0)).withColumn("strong", F.lit(2.0))
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns and {(r.score, r.words, r.ratio, r.strong) for r in kept.collect()} <= {(7, "w", 1.0, 2.0)}
    assert labels.count() and kept.count() <= docs.count()


PAGES = [(1, "http://a/ b\n", "x" * 2000), (2, None, "x" * 2000), (3, "u", "x" * 2000), (3, "u", "x" * 2000), (4, "u", None), (5, "u", ""), (6, "u", "é" * 400), (7, "u", "é" * 400), (None, "u", "x" * 2000), (8, "http://c/", "\r\n\r\nWARC/1.1\r\n" + "y" * 3000), (9, "u", "é" * 500), (10, "u", "é" * 500)]


def brute_pages(pages):
    last = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            last[b] = max(i, last.get(b, i))
    out, seen = [], set()
    for i, _, h in pages:
        b = (h or "").encode()
        first = last.get(b) == i and (b, i) not in seen
        if first:
            seen.add((b, i))
        revisit = b in last and not first
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[b] if revisit else None))
    return sorted(out, key=lambda t: (t[0] is None, t[0] or 0, str(t)))


@pytest.mark.parametrize("data", ["sf", "cases"])
def test_archives(spark, sf, data):
    pages = table(spark, sf, "pages") if data == "sf" else spark.createDataFrame([(*p, 9) for p in PAGES], "page_id long, url string, html string, no int").repartition(2)
    folder = new_path(spark, "w")
    got = warc.archive_pages(pages, folder, archive_bytes=20_000 if data == "sf" else 1 << 20)
    want = brute_pages([(r.page_id, r.url, r.html) for r in pages.collect()])
    digest = lambda df: sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=lambda t: (t[0] is None, t[0] or 0, str(t)))
    assert digest(got) == want
    # every member is a gzip file of its own at the offset that the sidecar names, and they fill the archive
    fs, root = pafs.FileSystem.from_uri(f"{folder}/normalised")
    names = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".gz")]
    assert len(names) > 1
    for name in names:
        data = fs.open_input_stream(name, compression=None).read()
        index = [json.loads(x) for x in fs.open_input_stream(name + ".idx").read().splitlines()]
        at = 0
        for e in index:
            assert e["offset"] == at and gzip.decompress(data[at : at + e["length"]]).startswith(b"WARC/1.1\r\n")
            at += e["length"]
        assert at == len(data)


def test_archives_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_damaged_streams():
    record = warc._record([("WARC-Type", "response")], b"abc")
    assert list(warc.records(iter([record[:5], record[5:]]))) == [({"WARC-Type": "response", "Content-Length": "3"}, b"abc")]
    for bad in (record[:-3], b"HTTP/1.1\r\n\r\n", record[:10]):
        with pytest.raises(ValueError):
            list(warc.records(iter([bad])))


def test_token_counts_equal_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer, models, normalizers

    from mercadia.llm.queries import VOCABULARY

    pieces = token_counts.vocabulary(VOCABULARY)
    full = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + pieces
    tokenizer = Tokenizer(models.Unigram(full, unk_id=0, byte_fallback=True))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(documents(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    docs = docs.unionByName(spark.createDataFrame([(90 + 10**6, "  two  blanks "), (91 + 10**6, "▁mark ▁"), (92 + 10**6, "日本語 \U0001f600\U0001f600 x\ty\n\nz"), (93 + 10**6, " "), (94 + 10**6, "aaaaaaaaaaaaaaaaaaaaaaaa" * 40)], "doc_id long, text string"))
    got = {}
    for r in docs.join(token_counts.token_counts(docs, pieces).distinct(), "doc_id").collect():
        got.setdefault(r.doc_id, (r.text, r.n_tokens))
    for i, (text, n) in got.items():
        assert n == len(tokenizer.encode(text or "", add_special_tokens=False).ids), i
    assert len(got) > 200 and token_counts.token_counts(empty(spark), pieces).count() == 0


def test_token_counts_ties_and_whole_search():
    # ab+c and a+bc tie: the longer last piece, found from the earlier start, stays
    for pieces, text, n in (([("ab", -1.0), ("c", -1.0), ("a", -1.0), ("bc", -1.0), ("b", -9.0), ("▁", -1.0)], "abc", 3), ([("▁a", -1.0), ("a▁b", -0.1), ("▁", -1.0), ("b", -1.0), ("a", -1.0)], "a b", 2)):
        assert token_counts.Counter(pieces).count(text) == n


SECRET = "of the tests"
PRIVATE = "Mail Éva.Lu-07@mail.example.com or eva@x.org, call +1 (743) 555-3824 or (743) 555-3824, card 4845 1681 1440 7329, host 97.51.17.173. Frau Anna Meier met Mr. Smith and Г-жа Анна Белова; order 9807915762804490, section 4.2."


def test_surrogates(spark, sf):
    docs = spark.createDataFrame([(1, PRIVATE), (2, "again 4845168114407329 and EVA@x.org."), (3, None), (4, ""), (5, "nothing here 1.2.3.999")], "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.pseudonymise(docs, SECRET).collect()}
    text = got[1].text
    for gone in ("Éva", "eva@x.org", "555-3824", "4845 1681", "97.51.17.173", "Meier", "Smith", "Белова"):
        assert gone not in text
    for kept in ("9807915762804490", "section 4.2", "Frau ", "Mr. ", "Г-жа "):
        assert kept in text
    assert (got[1].n_email, got[1].n_phone, got[1].n_card, got[1].n_ip, got[1].n_name) == (2, 2, 1, 1, 3)
    # format, coreference, gender and script
    a, b = re.search(r"call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4}),", text).groups()
    assert a == b
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}),", text)[1].replace(" ", "")
    assert card in got[2].text and sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(card))) % 10 == 0
    assert re.search(r"Frau (\S+) ", text)[1] in surrogates.GIVEN["latin"]["f"]
    assert re.search(r"Г-жа (\S+) ", text)[1] in surrogates.GIVEN["cyrillic"]["f"]
    assert (got[3].text, got[4].text, got[5].text) == (None, "", "nothing here 1.2.3.999")
    # another key gives other surrogates; the same gives the same
    assert surrogates.pseudonymise(docs, SECRET).where("doc_id = 1").first().text == text != surrogates.pseudonymise(docs, "other").where("doc_id = 1").first().text
    real = table(spark, sf, "documents")
    out = surrogates.pseudonymise(real, SECRET)
    assert out.count() == real.count() and out.where("n_email + n_phone + n_card + n_ip > 0").count() > 10
    assert surrogates.pseudonymise(empty(spark), SECRET).count() == 0 and surrogates.pseudonymise(documents(spark), SECRET).count() == documents(spark).count()


def test_surrogates_draw_again(spark, monkeypatch):
    # two octets of hash only: collisions are certain among so many
    narrow = surrogates._stream
    monkeypatch.setattr(surrogates, "_stream", lambda k, kind, form, attempt: F.rpad(F.substring(narrow(k, kind, form, attempt), 1, 3), 128, "0"))
    docs = spark.createDataFrame([(i, f"at 10.0.{i // 200}.{i % 200 + 1} now") for i in range(600)], "doc_id long, text string")
    new = [re.search(r"at (\S+) now", r.text)[1] for r in surrogates.pseudonymise(docs, SECRET).collect()]
    assert len(set(new)) == 600 and not set(new) & {f"10.0.{i // 200}.{i % 200 + 1}" for i in range(600)}


def entities_of(text):
    """(kind, canonical form) of each entity of a text in order, from plain code."""
    out = []
    for m in regex.finditer(surrogates.ENTITY, text or ""):
        m = m[0]
        digits = re.sub("[^0-9]", "", m)
        if "@" in m:
            out.append(("email", m.lower()))
        elif ":" in m:
            out.append(("ip6", m.lower()))
        elif regex.match(r"\p{Lu}", m):
            out += [("name", w.lower()) for w in regex.sub("^" + surrogates.TITLE, "", m).split(" ")]
        elif re.fullmatch(r"\d+\.\d+\.\d+\.\d+", m):
            out.append(("ip", m))
        elif m[0].isdigit() and len(digits) >= 13:
            if sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0:
                out.append(("card", digits))
        else:
            out.append(("phone", re.sub("^0", "", re.sub("[^0-9]", "", re.sub(rf"^\\+(?:{surrogates.COUNTRY})", "", m)))))
    return out


FORMS = "Mail иван.петров@mail.ru or Éva.Lu-07@mail.example.com; Ms Meier and Frau Anna Meier, later Anna Meier and Иван Петров and Dear Kim Possible. Tel (11) 98765-4321, +55 11 98765-4321, +44 20 7946 0958, (020) 7946 0958. Host fe80::1ff:FE23:4567:890a and std::vector a::b 12:30:45, Mr. Smith-Jones."


def test_surrogates_of_many_forms(spark):
    (r,) = surrogates.pseudonymise(spark.createDataFrame([(1, FORMS)], "doc_id long, text string"), SECRET).collect()
    got = r.text
    for gone in ("иван", "петров", "Éva", "Lu-07", "Meier", "Anna", "Иван", "Петров", "Kim", "Possible", "98765", "4321", "7946", "0958", "1ff", "FE23", "Smith", "Jones"):
        assert gone not in got
    assert re.search(r"Mail [а-я]+\.[а-я]+@\w+\.example\.ru or [A-Z][a-z]{2}\.[A-Z][a-z]-\d\d@", got)
    a, given, b, given2, c = re.search(r"Ms (\w+) and Frau (\w+) (\w+), later (\w+) (\w+) and [А-Я][а-я]+ [А-Я][а-я]+ and Dear", got).groups()
    assert a == b == c and given == given2 in surrogates.GIVEN["latin"]["f"]
    one, other = re.search(r"Tel \((\d\d)\) \d{5}-\d{4}, \+55 (\d\d \d{5}-\d{4}), ", got)[0][4:-2].split(", ")
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", other)[2:]
    assert re.search(r"\+44 (\d\d \d{4} \d{4}), \(0\d\d\) ", got)[1].replace(" ", "") in re.sub(r"\D", "", got[got.index("(0") :])[1:]
    assert re.search(r"Host [0-9a-f]{4}::[0-9a-f]{3}:[0-9A-F]{4}:\d{4}:[0-9a-f]{4} and std::vector a::b 12:30:45, Mr\. \w+-\w+\.$", got) or "std::vector a::b 12:30:45, Mr. " in got
    with pytest.raises(ValueError):
        surrogates.pseudonymise(empty(spark), "")


def test_surrogates_are_one_to_one(spark):
    made = [(10**6 + i, f"Frau {n} Meier{chr(97 + i % 26)} wrote to user{i % 40}@x{i % 7}.org from 10.0.0.{i % 9}") for i, n in enumerate(["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helga", "Irene", "Julia", "Karin", "Laura", "Maria", "Nina", "Olga", "Paula", "Xenia", "Zita"] * 5)]
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    before, after, known = {r.doc_id: r.text for r in docs.collect()}, surrogates.pseudonymise(docs, SECRET).collect(), {}
    for r in after:
        one, other = entities_of(before[r.doc_id]), entities_of(r.text)
        assert len(one) == len(other), r.doc_id
        assert r.n_email == sum(k == "email" for k, _ in one) and r.n_phone == sum(k == "phone" for k, _ in one)
        for x, y in zip(one, other):
            assert known.setdefault(x, y) == y and x[0] == y[0]
    assert len(set(known.values())) == len(known) > 200 and not set(known) & set(known.values())


def test_no_plan_shows_the_key(spark, sf):
    key = "a key that nobody should read in a plan"
    got = surrogates.pseudonymise(documents(spark), key)
    plan = got._jdf.queryExecution().toString() + got._jdf.queryExecution().logical().toString()
    pads = [bytes(b ^ pad for b in key.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C)]
    for secret in (key, *[p.hex() for p in pads], *[p[:20].decode("latin-1") for p in pads], str(list(pads[0][:6]))[1:-1]):
        assert secret not in plan and secret.upper() not in plan
    assert "pad_inner" in plan
