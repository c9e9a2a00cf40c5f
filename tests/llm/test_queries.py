"""Every registered opN_ query on a folder of tables, its contract columns against plain Python."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.llm import queries

SEED = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with rows planted: near copies, copies, null and repeated ids, empty texts, ties."""
    root, rng = str(tmp_path_factory.mktemp("tables")), random.Random(31)
    read = lambda name: spark.read.parquet(f"{SEED}/{name}.parquet")
    docs, items = read("documents"), read("benchmark")
    some = [r["text"] for r in docs.where("length(text) BETWEEN 300 AND 3000").orderBy("doc_id").limit(12).collect()]
    item = items.orderBy(F.desc(F.length("text"))).first()["text"]
    extra = [(100000 + i, t + " tail") for i, t in enumerate(some)] + [(100050 + i, t) for i, t in enumerate(some[:4])]
    extra += [(None, some[0]), (None, None), (100100, ""), (100101, " \n"), (100102, item), (100102, item), (100103, "x " * 40000 + item), (100104, "Dr. Иванов wrote to г-н Иванов")]
    planted = spark.createDataFrame([(i, t, "en", rng.choice(["s1", None]), len(t) if t is not None else None) for i, t in extra], docs.schema)
    docs.unionByName(planted).write.parquet(f"{root}/documents.parquet")
    items.write.parquet(f"{root}/benchmark.parquet")
    read("labels").write.parquet(f"{root}/labels.parquet")
    pages = read("pages")
    pages.unionByName(pages.limit(20).withColumn("page_id", F.col("page_id") + 5000)).unionByName(spark.createDataFrame([(9000, None, None), (9001, "u", "")], pages.schema)).write.parquet(f"{root}/pages.parquet")
    e = read("embeddings")
    e.unionByName(spark.createDataFrame([(9000, None, 0), (9001, [0.0] * 64, 0), (9002, [1.0, float("nan")], 0)], e.schema)).unionByName(e.limit(3)).write.parquet(f"{root}/embeddings.parquet")
    c = read("conversations")
    c.unionByName(spark.createDataFrame([(9000, 0, "user", None), (9000, 1, "assistant", "<|im_end|>\\ é"), (None, 0, "user", "x")], c.schema)).write.parquet(f"{root}/conversations.parquet")
    return root


def rows_of(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name,label,at", [("op1_toxicity", "toxic", 0.5), ("op5_mil_quality", "quality", 0.3)])
def test_classifiers(spark, folder, name, label, at):
    got = queries.QUERIES[name](spark, folder).collect()
    ids = [r[0] for r in rows_of(spark, folder, "documents", "doc_id")]
    assert ordered(r["doc_id"] for r in got) == ordered(ids)
    said = {}
    for r in got:
        assert r["held_out"] == (None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= at)
        said[r["doc_id"]] = r["predicted"]
    texts = dict(rows_of(spark, folder, "documents", "doc_id", "text"))
    by_text = {}
    for r in got:
        if r["doc_id"] is not None:
            by_text.setdefault(texts[r["doc_id"]], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())  # ids, languages and sources play no part
    larger = SEED.replace("0.001", "0.1")  # the smaller ones have some dozens of held-out texts, and few to learn from
    said = {r["doc_id"]: r["predicted"] for r in queries.QUERIES[name](spark, larger).collect()}
    truth = {i: y for i, y in rows_of(spark, larger, "labels", "doc_id", label) if y in (0, 1) and i in said}
    unseen = {i: y for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5 == 0}  # rows that no fit has seen
    assert len(unseen) > 700 and sum(said[i] == y for i, y in unseen.items()) >= 0.93 * len(unseen)
    rare = min((0, 1), key=lambda k: sum(y == k for y in truth.values()))
    assert sum(said[i] == y for i, y in unseen.items() if y == rare) >= 0.6 * sum(y == rare for y in unseen.values())


def test_op2(spark, folder):
    from windrose.llm.token_rollup import _encoder

    encode = _encoder(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken").encode_ordinary
    want = {}
    for text, lang, source in rows_of(spark, folder, "documents", "text", "lang", "source"):
        x = want.setdefault((source, lang, "byte_bpe_50k"), [0, 0, 0])
        for i, n in enumerate((1, len(encode(text or "")), len(text or ""))):
            x[i] += n
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["documents"], r["tokens"], r["chars"]] for r in queries.op2_token_rollup(spark, folder).collect()}
    assert got == want


def test_op3(spark, folder):
    talks = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for conv, turn, role, text in rows_of(spark, folder, "conversations", "conv_id", "turn", "role", "text"):
        talks.setdefault(conv, []).append((turn, role, text or ""))
    want = []
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        want.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = queries.op3_chat_tree(spark, folder).collect()
    assert ordered(tuple(r)[:5] for r in got) == ordered(want) and all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_op4(spark, folder):
    docs, items = rows_of(spark, folder, "documents", "doc_id", "text"), rows_of(spark, folder, "benchmark", "item_id", "text")
    want = []
    for i, (doc, text) in enumerate(docs):
        want.append(tuple({**brute.contamination([(i, text)], items)[i], "doc_id": doc}.values()))
    got = queries.op4_winnowing(spark, folder)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert ordered(tuple(r) for r in got.collect()) == ordered(want) and sum(w[-1] for w in want) >= 2


def test_op6(spark, folder):
    pages = [(i, (h or "").encode()) for i, h in rows_of(spark, folder, "pages", "page_id", "html")]
    last = {}
    for i, p in pages:
        last[p] = max(i, last.get(p, i))
    want = [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if last[p] == i else "revisit", None if last[p] == i else last[p]) for i, p in pages]
    got = queries.op6_warc_zstd(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert ordered(map(tuple, got)) == ordered(want)


def test_op7(spark, folder):
    vectors = rows_of(spark, folder, "embeddings", "vec_id", "embedding")
    good = [(i, np.array(v)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    links = [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(close), strict=True)]
    roots = brute.components({i for i, _ in vectors}, links)
    want = [(good[k][0], int(close[k].sum()), roots[good[k][0]]) for k in range(len(good))]
    want += [(i, 0, i) for i, v in vectors if i >= 9000]
    got = queries.op7_sorted_projection(spark, folder).collect()
    assert ordered((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == ordered(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_op8(spark, folder):
    texts = {}
    for i, t in rows_of(spark, folder, "documents", "doc_id", "text"):
        texts.setdefault(i, []).append(t)
    got = queries.op8_surrogates(spark, folder).collect()
    assert ordered(r["doc_id"] for r in got) == ordered(i for i, ts in texts.items() for _ in ts)
    mail = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}")
    assert any(mail.search(t or "") for ts in texts.values() for t in ts)
    for r in got:
        if not r["n_entities"]:
            assert r["text"] in texts[r["doc_id"]]
        for found in mail.findall(r["text"] or ""):
            assert found.endswith(".example")
    one = next(r["text"] for r in got if r["doc_id"] == 100104).split()
    assert one[1] == one[-1] != "Иванов" and re.fullmatch("[А-Я][а-я]+", one[1])


def test_op9(spark, folder):
    """The Poisson distribution inverted in plain Python at the same hashed numbers; rows that repeat are drawn apart."""
    from math import exp

    docs = rows_of(spark, folder, "documents", "doc_id", "source", "text")
    sources = [s for _, s, _ in docs]
    n = {s: sources.count(s) for s in sources}
    key = lambda doc, text: f"{'' if doc is None else f'#{doc}'}|{hashlib.md5((text or '').encode()).hexdigest()}"
    times = Counter(key(doc, text) for doc, _, text in docs)
    want = []
    for doc, source, text in docs:
        if times[key(doc, text)] > 1:
            continue
        rate = len(docs) / len(n) / n[source]
        parts = max(1, -int(-rate // 16))
        copies = 0
        for j in range(1, parts + 1):
            u, k, p = (int(hashlib.md5(f"17|{key(doc, text)}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52, 0, exp(-rate / parts)
            total = p
            while total < u and k < 88:
                k += 1
                p *= rate / parts / k
                total += p
            copies += k + (total < u)
        want += [(doc, copies, c, hashlib.md5(f"17|place|{key(doc, text)}|{c}".encode()).hexdigest()) for c in range(1, copies + 1)]
    got = queries.op9_poisson_mix(spark, folder).collect()
    once = [(r["doc_id"], r["n_copies"], r["copy"], r["place"]) for r in got if times[key(r["doc_id"], r["text"])] == 1]
    assert ordered(once) == ordered(want) and len({r["place"] for r in got}) == len(got) and max(times.values()) > 1


def test_op10(spark, folder):
    docs = rows_of(spark, folder, "documents", "doc_id", "text")
    sets, links = brute.jaccard_links([(k, t) for k, (_, t) in enumerate(docs)])
    roots = brute.components(range(len(docs)), links)
    least = {}
    for k, (doc, _) in enumerate(docs):
        if doc is not None:
            least[roots[k]] = min(doc, least.get(roots[k], doc))
    want = [(doc, len(sets[k]), least.get(roots[k])) for k, (doc, _) in enumerate(docs)]
    assert ordered(map(tuple, queries.op10_parity_join(spark, folder).collect())) == ordered(want) and len(links) > 12
