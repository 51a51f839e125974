"""The registered queries and the pipeline over small tables, against plain Python twins."""

import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_operators import BASE, ODD, brute_kept
from tokenizers import Tokenizer

import corpus_pipeline
from tidepress.llm import langid, packing, pii, quality
from tidepress.llm.queries import QUERIES

DE = "Der Wind und die Wolken zogen schnell über das weite Land hinweg. "
BAD = "word!! TEXT!! MORE!! NOISE!! "
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, own_turn int"
DATA = "/root/testdata/sf0.01"


def corpus():
    r = np.random.default_rng(2)
    words = [w for w in re.findall(r"\w+", BASE + DE) for _ in range(1)]
    prose = [(" ".join(r.choice(words[:23], 40)) + ". " + BASE, "en") for _ in range(25)] + [(" ".join(r.choice(words[23:], 40)) + ". " + DE, "de") for _ in range(15)]
    near = [(t.replace("storm", "rain", 1), lang) for t, lang in prose[:4]]
    bad = [(BAD * (5 + i % 3) + str(i), "en") for i in range(20)]
    private = [(prose[i][0] + f" card 4845168114407329 on 1985-03-1{i}", prose[i][1]) for i in (30, 31)]
    foreign = [("Ветер и облака быстро неслись над широкой землёй. " * 5, None)]
    return [*prose, *prose[:3], *near, *bad, *private, *foreign, *((t, None) for t in ODD)]


def written(spark, folder, rows, ids=None):
    ids = list(range(len(rows))) if ids is None else ids
    data = [(i, t, lang, "s", None if t is None else len(t), "clash", 5, 6) for i, (t, lang) in zip(ids, rows, strict=True)]
    spark.createDataFrame(data, EXTRA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    good = {i: int("!!" not in t) for i, (t, _) in zip(ids, rows, strict=True) if t and i is not None and len(t) > 60}
    spark.createDataFrame([(i, q, 0) for i, q in good.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("small"), corpus())


def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{sf_dir}/out-{name}")
        docs = spark.read.parquet(f"{sf_dir}/out-{name}")
        out.append(docs)
    return out


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_every_stage_equals_its_plain_twin(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one, two, three, four, five = stages(spark, small)
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    before, texts = texts_of(docs), texts_of(one)
    model = quality.fit(spark, docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert texts == {i: t for i, t in before.items() if model.score([t])[0] >= corpus_pipeline.GOOD}
    assert not any(t and t.startswith(BAD) for t in texts.values())
    learned = langid.fit(spark, one)
    floor = langid.floors(spark, one, learned)

    def known(t):
        _, size, fit, count = learned.infer([t])
        return bool(size[0] and t and re.search(r"[^\W\d_]", t) and fit[0] >= floor[langid.length_class(count)][0])

    assert texts_of(two) == {i: t for i, t in texts.items() if known(t)} and not any("Ветер" in t for t in texts_of(two).values())
    ids = sorted(texts_of(two))
    kept = {ids[i] for i in brute_kept([texts[i] for i in ids])}
    assert set(texts_of(three)) == kept and len(kept) < len(ids)
    make = pii.Pseudonymiser()
    assert texts_of(four) == {i: make.apply(t)[0] for i, t in texts_of(three).items()} and not any("4845168114407329" in t for t in texts_of(four).values())
    assert {r["doc_id"]: r["n_chars"] for r in four.collect()} == {i: len(t) for i, t in texts_of(four).items()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = five.toPandas()
    for i, part in got.sort_values("piece").groupby("doc_id"):
        assert [int(x) for p in part["ids"] for x in p] == [*library.encode(texts_of(four)[i], add_special_tokens=False).ids, 0]
    assert set(got.doc_id) == kept and got.groupby("sequence_id").length.sum().max() <= packing.MAX_TOKENS
    assert corpus_pipeline.run(spark, small).count() == len(got)


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    (tmp_path / "odd").mkdir(), (tmp_path / "none").mkdir()
    rows = [*corpus()[:30], (None, None), ("", "en"), (BASE, "en"), (BASE, "en"), (BASE, None)]
    odd = written(spark, tmp_path / "odd", rows, [*range(30), None, 31, 32, 32, None])
    *_, four, five = stages(spark, odd)
    ids = [r["doc_id"] for r in four.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and None not in ids and five.select("doc_id").distinct().count() == len(ids)
    none = written(spark, tmp_path / "none", [])
    assert [s.count() for s in stages(spark, none)] == [0] * 5
    assert corpus_pipeline.run(spark, none).count() == 0


CONTRACT = {
    "op1_": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op2_": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op5_": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op7_": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_": "doc_id bigint, text string",
    "op10_": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
}


@pytest.mark.parametrize("start", CONTRACT)
def test_queries_return_what_they_must(spark, small, start):
    (name,) = [q for q in QUERIES if q.startswith(start)]
    df = QUERIES[name](spark, small)
    got = dict(df.dtypes)
    assert all(got[c.split()[0]] == c.split()[1] for c in CONTRACT[start].split(", "))
    rows = df.toPandas()
    assert set(rows.doc_id) == set(range(len(corpus()))) and (start == "op6_" or len(rows) == len(corpus()))
    crc = rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()))
    if start == "op5_":
        assert (rows.held_out == (crc % 4 == 2)).all() and rows.score.between(0, 1).all() and set(rows.lang_pred) <= {"de", "en", "und"}
        assert all((p == "und") == (not t or not re.search(r"[^\W\d_]", t)) for p, (t, _) in zip(rows.set_index("doc_id").lang_pred.sort_index(), corpus(), strict=True))
    if start == "op8_":
        assert (rows.held_out == (crc % 5 == 0)).all() and rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    if start == "op10_":
        assert set(rows.law) == {"bytes"} and rows.grown_shard.isna().all() and rows.shard.between(0, 23).all()
    if start == "op6_":
        assert (rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id").apply(lambda g: (g.offset == g.length.cumsum() - g.length).all(), include_groups=False)).all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = QUERIES["op5_language_mixture"](spark, DATA).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(lang) > 200 and (lang.lang_pred == lang.lang).mean() >= 0.99
    label = QUERIES["op8_line_field"](spark, DATA).filter("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    assert len(label) > 50 and (label.predicted == label.quality).mean() >= 0.95
