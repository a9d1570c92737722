"""Each operator against a brute-force version or an exact round trip, and its edge cases."""

import hashlib
import json
import os
import zlib

import duckdb
import numpy as np
import pytest

from isochrona.llm import _store, chat, mixing, ngram, pieces, pii, quality, simhash, tokenfile, vectors, wordpiece

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "abc def ghi jkl mno pqr stu vwx yz " * 4000
ODD = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \n ", "en", "a", 0), (3, " \n ", "en", "a", 0), (None, "x y", "en", None, 3), (4, LONG, "en", "b", 9), (5, "▁ é\t 日本 \\ [INST]", "en", "b", 9), (6, "z" * 50000, "en", "b", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).selectExpr("*", "1 AS words", "'u' AS size", "'v' AS ids_")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


REPORTS = [quality.quality_report, pii.pii_report, ngram.lm_report, wordpiece.token_counts, tokenfile.tokenfile_report, simhash.simhash_report, mixing.mixing_report, pieces.pieces_report]


@pytest.mark.parametrize("report", REPORTS, ids=lambda f: f.__name__)
def test_odd_and_empty_tables(odd, report):
    assert len(report(odd).collect()) == len(ODD)
    assert report(odd.where("false")).collect() == []


def test_quality_matches_sql(docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = con.sql(quality.REPORT_SQL), quality.quality_report(docs)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_pseudonyms_keep_form_and_are_linked(spark):
    card, other = "4041894974608795", "4041894974608796"
    rows = [(i, t, None, None, 0) for i, t in enumerate((f"a {card} b", f"{card}!", f"{other}", "no find in 3 words", "on 2021-03-04", "from 04.03.2021", "+1 (988) 555-2485", "42.144.35.254 300.1.1.1"))]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()]
    new = got[0].split()[1]
    assert new != card and got[1] == f"{new}!" and got[2] == other and got[3] == rows[3][1]
    assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(new))) % 10 == 0
    y, m, d = got[4].split()[1].split("-")
    assert got[5] == f"from {d}.{m}.{y}"
    assert got[6].startswith("+1 (") and got[6] != rows[6][1] and got[7].endswith(" 300.1.1.1")


def test_feistel_is_a_bijection(spark):
    step = pii.feistel("named_struct('tag', 't', 'l', id div 30, 'r', id % 30, 'ml', 31L, 'mr', 30L)")
    assert spark.range(930).selectExpr(f"{step} AS p").selectExpr("p.l * 30 + p.r AS x").distinct().where("x BETWEEN 0 AND 929").count() == 930


def test_base_scores_are_exact(docs):
    got, rows = {r.doc_id: r for r in ngram.lm_report(docs).collect()}, docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    counts = {}
    for r in rows:
        for w in ngram.words_of(r.text) if not held[r.doc_id] else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        words = ngram.words_of(r.text)
        want = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words)
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(words), sum(w in counts for w in words), n)
        assert abs(g.base_score - want) < 1e-6 * abs(want)
    out = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)


@pytest.mark.parametrize("most", [(10, 100), (100, 3), (5, 3), (1, 100), (1, 1)])
def test_all_tokens_are_counted_whatever_is_held(monkeypatch, most):
    import pandas as pd

    monkeypatch.setattr(ngram, "PAIRS_HELD", most[0])
    monkeypatch.setattr(ngram, "WORDS_HELD", most[1])
    found = pd.concat(ngram._gathered([pd.DataFrame({"t": ["a b c d", "e f g h"]}), pd.DataFrame({"t": []})]))
    assert found["n"][found["w"].notna()].sum() == found["n"][found["w"].isna()].sum() == 10


def test_scores_do_not_depend_on_how_the_filter_is_held(monkeypatch, docs, odd):
    both = docs.selectExpr("doc_id", "text").unionByName(odd.selectExpr("doc_id", "text"))
    want = sorted(map(tuple, ngram.lm_report(both).collect()), key=str)
    monkeypatch.setattr(ngram, "MOST_BITS", 1 << 19)
    for batch in (1, 5000, 1 << 20):
        monkeypatch.setattr(ngram, "BATCH", batch)
        got = sorted(map(tuple, ngram.lm_report(both).collect()), key=str)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=0)


def test_longest_match_equals_greedy():
    match = wordpiece.LongestMatch(["a", "ab", "abc"], ["b", "c", "cd", "bcd", "e"])
    inner, begin = {"b", "c", "cd", "bcd", "e"}, {"a", "ab", "abc"}

    def greedy(w):
        n, i = 0, 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in (begin if i == 0 else inner)), None)
            if j is None:
                return 1, 1
            n, i = n + 1, j
        return n, 0

    for w in ("a", "abcd", "abccd", "abcde", "ae", "abx", "b", "abbcdcdcde"):
        assert match.count(w) == greedy(w), w


def test_token_files_read_back(docs):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(tokenfile.vocabulary_path()), 0
    got = tokenfile.tokenfile_report(docs).orderBy("doc_id").collect()
    for d, g in zip(docs.orderBy("doc_id").collect(), got, strict=True):
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert tuple(g) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("text", ["a  b", "a   b \n c", " lead", "trail ", "\n\n x \t y", "don't stop. 'll\nA.b", "x.\n\nY", "<|endoftext|> x", "é.\nÈ,a!b", "日本 12.5", "a.,;b ...c"])
def test_encoder_equals_library(text):
    e = tokenfile.Encoder(tokenfile.vocabulary_path())
    assert np.frombuffer(e(text), "<u2").tolist() == e.model.encode(text, add_special_tokens=False).ids


def test_encoder_equals_library_on_any_signs(monkeypatch):
    import random

    random.seed(5)
    monkeypatch.setattr(tokenfile, "CACHE", 40)  # the store is full again and again
    e = tokenfile.Encoder(tokenfile.vocabulary_path())
    some = [*"aBé日5 \n\t.,'*#_`|~", " ", " ", "\u00a0", "\u2003", "\x1c", "the", "'ll", "***", "\r\n", "ª", "İ", "e\u0301"]
    for _ in range(4000):
        text = "".join(random.choices(some, k=random.randrange(14)))
        assert np.frombuffer(e(text), "<u2").tolist() == e.model.encode(text, add_special_tokens=False).ids, text


def test_encoder_takes_a_word_from_its_signs():
    class Counted:
        def __init__(self, model):
            self.model, self.texts = model, []

        def encode(self, text, **more):
            self.texts.append(text)
            return self.model.encode(text, **more)

    e = tokenfile.Encoder(tokenfile.vocabulary_path())
    e.model = Counted(e.model)
    words = [f"wo{a}{b}" for a in "abcdefgh" for b in "rstuvw"]
    text = "x " + " ".join(w + signs for w in words for signs in ("***", "%%%", ".###", ""))
    assert np.frombuffer(e(text), "<u2").tolist() == e.model.model.encode(text, add_special_tokens=False).ids
    assert len(e.model.texts) <= 5


def test_index_finds_stored_keys_only():
    keys = [None, None, *range(-5000, 5000, 3), 4996, 7**15]
    shard = tokenfile.Shard(tokenfile.shard_bytes(keys, [b"\x01\x00" * (i % 3) for i in range(len(keys))], 2))
    first, n = shard.get([k for k in keys[2:]])
    assert (n >= 1).all() and [keys[i] for i in first] == keys[2:]
    assert shard.get([-4999, 1, 8])[1].tolist() == [0, 0, 0] or (shard.get([-4999])[1] == 0).all()


def test_simhash_groups_equal_brute_force(docs):
    rows = docs.collect()
    prints = [simhash.fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    want = {r.doc_id: min(q.doc_id for q, y in zip(rows, root, strict=True) if y == x) for r, x in zip(rows, root, strict=True)}
    got = simhash.simhash_report(docs).collect()
    assert {g.doc_id: g.component_id for g in got} == want
    assert {g.doc_id: g.fingerprint for g in got} == {r.doc_id: f"{p:016x}" for r, p in zip(rows, prints, strict=True)}


def test_links_reach_the_radius_given(spark):
    far = sum(1 << i for i in range(3, 64, 11))  # 6 bits, one in each sixth
    points = spark.createDataFrame([(0, 1), (far, 1), (0x0F0F0F0F0F0F0F0F, 1)], "fp long, n long")
    assert sorted(map(tuple, simhash.linked(points, radius=6).collect())) == [(0, 0), (far, 0), (0x0F0F0F0F0F0F0F0F, 0x0F0F0F0F0F0F0F0F)]


def test_chat_reads_back_whole(spark):
    turns = [(9, 0, "system", "be [INST] <|x|>"), (9, 1, "user", None), *[(9, 2 + i, ("user", "assistant")[i % 2], f"w{i} " * (60 * (i % 5))) for i in range(12)], (None, 0, None, "\\[ </s>")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_report(df).collect()}
    own = [(r or "", t or "") for c, _, r, t in turns if c == 9]
    learnt = "".join(t for r, t in own if r == "assistant")
    assert got[9].n_turns == len(own) and got[9].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert got[9].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
    assert set(got) == {9, None, -1}
    assert {r.conv_id for r in chat.chat_report(df.where("false")).collect()} == {-1}


def test_mix_meets_targets(docs):
    got = mixing.mixing_report(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixing_report(docs).collect()), key=str)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), rows in by.items():
        assert abs(sum(r.taken for r in rows) - target) <= max(r["size"] for r in rows)


def test_pieces_without_dropout_equal_library_and_all_decode(docs):
    import sentencepiece

    path = pieces.vocabulary_path(pieces.VOCABULARY)
    plain, varied, library = pieces.Pieces(path, 0.0), pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in [" a", "a  b   c", "a\n b\n\n c", "\n", "日本語", "🙂 ok", "▁x ▁ y", "q" * 99, *(r.text or "" for r in docs.limit(50).collect())]:
        if "▁" not in text:
            assert plain.encode(text).tolist() == library.encode(text)
        assert varied.decode(varied.encode(text).tolist()) == text


def test_piece_columns_equal_heap_and_blocks(monkeypatch, docs):
    texts = ["", "a", "▁", "x▁y  z", " " * 200, "x" * 300 + "ab" * 200, *(r.text or "" for r in docs.limit(20).collect())]
    model = pieces.Pieces(pieces.vocabulary_path(pieces.VOCABULARY))
    columns = [x.tolist() for x in model.encode_all(texts)]
    assert columns == [model.encode(t).tolist() for t in texts]
    assert len({tuple(x) for x in (model.encode("w" * k + " international")[-6:].tolist() for k in range(40))}) > 1
    monkeypatch.setattr(pieces, "BLOCK", 50)
    monkeypatch.setattr(pieces, "LONG", 1)
    monkeypatch.setattr(pieces, "WIDTHS", ())
    assert columns == [x.tolist() for x in model.encode_all(texts)]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    e = np.concatenate([base, base[:10] + 0.02 * rng.standard_normal((10, 16)), base[:1] + 0.03 * rng.standard_normal((60, 16)), base[3:5]])
    rows = [(i, v.tolist(), int(i % 2) if i < 40 else 0) for i, v in enumerate(e)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, base[0].tolist(), None)]
    got = {r.vec_id: r for r in vectors.vector_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[: len(e)]])
    link = (unit @ unit.T >= vectors.LEAST) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    assert [got[i].n_links for i in range(len(e))] == link.sum(1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))


def test_representatives_of_odd_ids(spark, odd):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in ((1, None), (None, "x y"), (4, LONG), (5, ODD[6][1]), (6, ODD[7][1])))
    texts = ("one two three four five six", "red green blue white black brown", "north south east west up down")
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (None, texts[2]), (None, texts[2]), (None, "x y"), (9, texts[0])]
    got = simhash.representatives(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(7, texts[0]), (7, texts[1]), (0, texts[2]), (0, "x y")])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    kept = {r.doc_id for r in quality.quality_report(docs).collect() if r.kept}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    once = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, good, SF).collect()}
    assert once == {r.component_id for r in simhash.simhash_report(good).collect()}
    out, model = corpus_pipeline.run(spark, SF).collect(), pieces.Pieces(pieces.vocabulary_path(pieces.VOCABULARY))
    assert out and {r.doc_id for r in out} <= once
    clean = {r.doc_id: r.text for r in pii.pseudonymise(docs).collect()}
    assert all(model.decode(r.ids) == clean[r.doc_id] for r in out)


def test_queries_are_registered():
    from isochrona.llm import queries

    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 11))
    assert json.dumps(sorted(queries.ORACLE_SQL))


def test_a_filter_that_is_never_broadcast_gives_the_same_scores(monkeypatch, docs):
    want = sorted(map(tuple, ngram.lm_report(docs).collect()))
    monkeypatch.setattr(ngram, "MOST_BITS", 0)
    got = sorted(map(tuple, ngram.lm_report(docs).collect()))
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=0)


def test_rows_of_a_segment_are_probed_together(monkeypatch):
    import pandas as pd

    cut, some = ngram.Segments(4), np.unique(ngram._words(np.arange(4000, dtype=np.uint64)))
    own = {s: some[x] for s, x in cut.cut(some)}
    words = {s: pd.DataFrame([(cut.pack(s, g), ngram._packed(np.full(len(g), 3)), None)], columns=["pairs", "n", "words"]) for s, g in own.items() if s != 7}
    bits = {s: ngram._built(4)((s,), p)["found"][0] for s, p in words.items()}
    rows = [(s, b, held) for s, g in own.items() for b, held in [*([(None, bits[s])] if s in bits else []), *[(b, cut.pack(s, g[b::40])) for b in range(40)]]]
    called, plain = [], ngram._levels
    monkeypatch.setattr(ngram, "_levels", lambda *a: called.append(1) or plain(*a))
    table = pd.DataFrame(rows, columns=["segment", "batch", "held"])
    cuts = [table[:100], table[100:101], table[101:]]
    got = pd.concat(list(ngram._probed(4, 2)(cuts)))
    assert len(called) <= len(own) + len(cuts)
    assert sorted(zip(got["segment"], got["batch"])) == sorted((s, b) for s in own for b in range(40))
    for s, b, levels in zip(got["segment"], got["batch"], got["levels"], strict=True):
        assert len(levels) == len(own[s][b::40]) and set(levels) == ({0} if s == 7 else {2})


def test_probes_end_at_the_greatest_level_of_a_full_filter():
    full = ngram.Filter(4, 3, np.full(16, 64), b"\xff" * 128)
    assert full.levels(ngram._words(np.arange(100, dtype=np.uint64))).tolist() == [3] * 100
    empty = ngram.Filter(4, 3, np.full(16, 64), bytes(128))
    assert empty.levels(ngram._words(np.arange(100, dtype=np.uint64))).tolist() == [0] * 100


def test_packed_numbers_come_back():
    for x in ([], [0], [255, 256], [2**48 - 1, 0, 5], [1] * 1000):
        assert ngram._unpacked(ngram._packed(np.array(x, np.uint64))).tolist() == x
    cut, g = ngram.Segments(6), np.unique(ngram._words(np.arange(5000, dtype=np.uint64)))
    assert np.array_equal(np.concatenate([cut.unpack(s, cut.pack(s, g[x])) for s, x in cut.cut(g)]), g)


BIG = [(1152921504606846977, "one two three four five", "en", "a", 3), (None, "red green blue white", "en", "a", 3), (1152921504606846979, "north south east west", "en", "b", 3)]


@pytest.mark.parametrize("report", [ngram.lm_report, wordpiece.token_counts, simhash.simhash_report, pieces.pieces_report], ids=lambda f: f.__name__)
def test_long_keys_beside_a_null_stay_whole(spark, report):
    got = report(spark.createDataFrame(BIG, DOCS).coalesce(1)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in BIG}
    if "component_id" in got[0]:
        assert {r.component_id for r in got} == {r[0] for r in BIG}


def test_piece_columns_of_any_type_are_carried(spark):
    rows = spark.createDataFrame(BIG, DOCS).selectExpr("*", "cast(doc_id AS decimal(38, 0)) AS d", "array(doc_id) AS a", "map('k', doc_id) AS m", "timestamp'2024-01-02' AS ts").coalesce(1)
    back = pieces.decode(pieces.encode(rows)).select(*rows.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_chat_equals_sql_and_keeps_the_budget(spark):
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rng = np.random.default_rng(3)
    rows = [(c, int(i), str(r), " ".join(["wörd"] * int(k)) + "[" * int(k % 3)) for c in range(60) for i, (r, k) in enumerate(zip(rng.choice(["user", "assistant", "system"], 40), rng.integers(0, 10 ** rng.integers(1, 4), 40), strict=True))]
    rows += [(77, 0, "system", "be kind " * 200), *[(77, 1 + i, ("user", "assistant")[i % 2], "word " * 90) for i in range(28)], (78, 1, "user", "same"), (78, 1, "user", "same"), (78, None, None, None), (None, 2, "assistant", "字" * 5000)]
    own = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((r or "", x or ""))
    for name, df in (("conversations", table), ("own", own)):
        if name == "own":
            arrow = own.toArrow()  # noqa: F841
            sql.sql("CREATE OR REPLACE VIEW conversations AS SELECT * FROM arrow")
        want, got = sql.sql(chat.REPORT_SQL), chat.chat_report(df)
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
    made = chat.windows(own).selectExpr("conv_id", "window", "tokens", "n_repeated", "formatted", "size(split(formatted, '</s>')) - 1 AS n").collect()
    assert all(w.tokens <= chat.BUDGET or w.n - w.n_repeated == 1 for w in made)
    for c, own_turns in turns.items():
        back = [w for w in sorted(made, key=lambda w: w.window) if w.conv_id == c]
        assert sum(w.n - w.n_repeated for w in back) == len(own_turns)
        if own_turns[0][0] == "system":
            assert all(w.formatted.startswith("<|system|>") for w in back)


@pytest.mark.parametrize("n, common", [(6000, 0.0), (6000, 0.8), (30000, 0.8)])
def test_vectors_equal_brute_force_with_recall(spark, n, common):
    """Random pairs near the threshold, in one label, around a common direction of the given cosine."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    e = rng.standard_normal((n, 64))
    e = np.sqrt(1 - common) * e / np.linalg.norm(e, axis=1, keepdims=True) + np.sqrt(common) * centre
    k = n // 10
    e[:k] = e[k : 2 * k] + rng.uniform(0.1, 0.21, (k, 1)) * (lambda z: z / np.linalg.norm(z, axis=1, keepdims=True))(rng.standard_normal((k, 64)))
    e = e.astype(np.float32)
    unit = e.astype(np.float64) / np.linalg.norm(e.astype(np.float64), axis=1, keepdims=True)
    pairs = [(i, j + lo) for lo in range(0, n, 2000) for i, j in zip(*np.nonzero(unit @ unit[lo : lo + 2000].T >= vectors.LEAST), strict=True) if i < j + lo]
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    links = np.bincount(np.array(pairs).ravel(), minlength=n)
    df = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(e)], "vec_id long, embedding array<float>, label int, id string")
    got = {r.vec_id: r for r in vectors.vector_report(df).collect()}
    assert sum(g.n_links for g in got.values()) >= 0.9 * 2 * len(pairs) and len(pairs) > k / 2
    assert all(got[i].n_links <= links[i] for i in range(n))
    same = [got[i].component_id == top(i) and got[i].kept == (top(i) == i) for i in range(n) if links[i]]
    assert sum(same) >= 0.9 * len(same)


def test_vectors_of_odd_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, id string, v int"
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [2.0, 0.0], 1), (5, [2.0, 0.0], 1), (6, None, 1), (7, [], 1), (8, [1.0, None], 1), (9, [1.0, 0.0, 0.0], 1), (10, [-0.0, 1.0], 2), (11, [0.0, 1.0], 2)]
    got = sorted(map(tuple, vectors.vector_report(spark.createDataFrame([(*r, "i", 0) for r in rows], schema)).collect()), key=str)
    assert got == sorted([(None, 3, 5, None), (None, 3, 5, None), (5, 3, 5, True), (5, 3, 5, True), *[(i, 0, i, True) for i in (6, 7, 8, 9)], (10, 1, 10, True), (11, 1, 10, False)], key=str)
    assert vectors.vector_report(spark.createDataFrame([], schema)).collect() == []


def test_repeated_rows_are_taken_up_to_the_target(spark):
    rows = [(1, "a b c " * 30, "s")] * 50 + [(i, "x y z", "t") for i in range(200)] + [(2, "a b", None)] * 7
    got = mixing.mixing_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size = {"s": 4500, "t": 600, None: 14}
    # Weights 1, 2, 3 of all 5114 words; t and the null source stop at three times their size.
    target = {"t": 1800.0, None: 42.0, "s": 5114 - 1842.0}
    for s, n in size.items():
        own = [r for r in got if r.source_size == n]
        assert {round(r.target, 6) for r in own} == {target[s]} and abs(sum(r.taken for r in own) - target[s]) <= max(r["size"] for r in own)
        assert all(r.taken == r["size"] * len(r.shards) for r in own)


def test_targets_by_repeated_resharing(docs):
    sizes, got = {}, {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    want, free, left = {}, {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}, sum(sizes.values())
    while free:
        over = {s: 3 * sizes[s] for s, w in free.items() if left * w / sum(free.values()) > 3 * sizes[s]}
        if not over:
            want |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        want |= over
        left, free = left - sum(over.values()), {s: w for s, w in free.items() if s not in over}
    for r in mixing.mixing_report(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        got[r.source] = r.target
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * want[s] for s in want)


def test_shards_are_written_in_shuffled_order(spark, docs, tmp_path):
    mixed = mixing.mix(docs.selectExpr("*", "1 AS row", "2 AS _x", "3 AS id"))
    mixing.write_shards(mixed, f"file://{tmp_path}/mix")
    written = spark.read.parquet(f"file://{tmp_path}/mix")
    assert sorted((r.row.doc_id, r.shard) for r in written.collect()) == sorted((r.row.doc_id, r.shard) for r in mixed.collect())
    assert mixed.select("row.*").columns == [*docs.columns, "row", "_x", "id"]
    place = {(r.shard, r.place): r.row.doc_id for r in mixed.collect()}
    for shard in {s for s, _ in place}:
        own = [r.row.doc_id for r in spark.read.parquet(f"file://{tmp_path}/mix/shard={shard}").collect()]
        assert own == [place[x] for x in sorted(place) if x[0] == shard]
    assert mixing.plan(10**9, 10**12) == (1 << 18, 1 << 15)


def _feistel(tag, l, r, ml, mr):
    h = lambda i, half, m: int(hashlib.sha256(f"{pii.KEY}:{tag}:{i}:{half}".encode()).hexdigest()[:15], 16) % m
    for i in range(pii.ROUNDS):
        l, r = ((l + h(i, r, ml)) % ml, r) if i % 2 == 0 else (l, (r + h(i, l, mr)) % mr)
    return l, r


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _pseudonym(m):
    """Brute force of one find, None if it does not validate."""
    import datetime
    import re

    d = re.sub("[^0-9]", "", m)
    refill = lambda new: (lambda it: re.sub("[0-9]", lambda _: next(it), m))(iter(new))
    sha = lambda x: hashlib.sha256(f"{pii.KEY}:{x}".encode()).hexdigest()
    if "@" in m:
        return "u" + sha(m.lower())[:12] + m[m.index("@") :]
    if m.startswith("AKIA"):
        return "AKIA" + sha(m)[:16].upper()
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        a = m.split(".")
        if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in a):
            return None
        a = [int(x) for x in a]
        l, r = _feistel("ip", a[0] * 256 + a[1], a[2] * 256 + a[3], 65536, 65536)
        return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        l, r = _feistel("ssn", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 989901)
        return f"{l + 1 + (l > 664):03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"
    for form in ("%m/%d/%Y", "%d.%m.%Y", "%Y-%m-%d"):
        if re.fullmatch({"%m/%d/%Y": r"\d\d/\d\d/\d{4}", "%d.%m.%Y": r"\d\d\.\d\d\.\d{4}", "%Y-%m-%d": r"\d{4}-\d\d-\d\d"}[form], m):
            first = datetime.date(1900, 1, 1)
            try:
                x = (datetime.datetime.strptime(m, form).date() - first).days
            except ValueError:
                return None
            if not 0 <= x < pii.DAYS:
                return None
            while True:
                l, r = _feistel("date", x // pii.DAY_R, x % pii.DAY_R, pii.DAY_L, pii.DAY_R)
                x = l * pii.DAY_R + r
                if x < pii.DAYS:
                    return (first + datetime.timedelta(x)).strftime(form)
    if re.fullmatch(r"\d{13,19}|\d{4}[ -]\d+[ -]\d+([ -]\d+)?", m) and not re.search(r" \d{3} \d{4}$", m):
        if not _luhn(d):
            return None
        b = d[1:-1]
        n, k = len(b), len(b) // 2
        l, r = _feistel(f"card{d[0]}-{n}", int(b[:k]), int(b[k:]), 10**k, 10 ** (n - k))
        new = f"{d[0]}{l:0{k}d}{r:0{n - k}d}"
        return refill(next(new + c for c in "0123456789" if _luhn(new + c)))
    if re.fullmatch("[0-9a-zA-Z]+", m):
        return sha(m)[: len(m)]
    t, x = d[-10:], 0
    area, exchange, serial = int(t[:3]), int(t[3:6]), int(t[6:])
    if area >= 200 and exchange >= 200:
        x = ((area - 200) * 800 + exchange - 200) * 10000 + serial
        l, r = _feistel("phone", x // 80000, x % 80000, 80000, 80000)
        x = l * 80000 + r
        new = f"{x // 8000000 + 200:03d}{x // 10000 % 800 + 200:03d}{x % 10000:04d}"
    else:
        x = int(t) if area < 200 else 2 * 10**9 + ((area - 200) * 200 + exchange) * 10000 + serial
        l, r = _feistel("phone-", x // 60000, x % 60000, 60000, 60000)
        x = l * 60000 + r
        y = x - 2 * 10**9
        new = f"{x:010d}" if y < 0 else f"{y // 2000000 + 200:03d}{y // 10000 % 200:03d}{x % 10000:04d}"
    return refill(d[:-10] + new)


def test_pseudonyms_equal_brute_force(spark, docs):
    import regex

    odd_texts = ["a1b2c3d4e5f6a1b2c3d4e5f6a1b2c3d4 alone", "11b2c3d4e5f6a1b2c3d4e5f6a1b2c3d4", "1.2.3.4 and 01.2.3.4", "300.1.1.1", "123-45-6789, 666-12-3456, 665-01-0001, 667-01-0001, 899-99-9999", "(123) 456-7890 or 212-155-0001 or +1 212 555 0100", "31.02.2020 29.02.2020 12/31/2099 2100-01-01", "4041 8949 7460 8795", "password=hunter2hunter2", "", None]
    table = docs.selectExpr("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd_texts)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in table.collect()}
    for g in pii.pii_report(table).collect():
        n = 0

        def one(m):
            nonlocal n
            p = _pseudonym(m.group())
            n += p is not None
            return m.group() if p is None else p

        want = None if texts[g.doc_id] is None else regex.sub(pii.FINDS, one, texts[g.doc_id])
        assert (g.text, g.n_finds) == (want, n), g.doc_id


def test_keys_with_quotes_and_valid_forms(spark):
    rows = spark.createDataFrame([(i, f"{a:03d}-{g:02d}-{s:04d} and {i % 256}.1.2.3 and ({i % 1000:03d}) 555-{i % 10000:04d}", i) for i, (a, g, s) in enumerate((a, g, s) for a in (1, 665, 667, 899) for g in (1, 99) for s in range(1, 60))], "doc_id long, text string, _p int")
    got = pii.pseudonymise(rows, key="it's a \\ key").collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "_p"} and len({r.text.split()[0] for r in got}) == len(got)
    for r in got:
        area, group, serial = map(int, r.text.split()[0].split("-"))
        assert 0 < area < 900 and area != 666 and group and serial
        assert r.text.split()[0] != rows.where(f"doc_id = {r.doc_id}").first().text.split()[0] if r.doc_id < 3 else True


def test_every_find_holds_a_hint(docs):
    import random

    import regex

    rng, finds, hint = random.Random(2), regex.compile(pii.FINDS), regex.compile(pii.HINT)
    odd_texts = ["".join(rng.choices("0123456789abcdefAKIZ.@-/ =:()+", k=60)) for _ in range(20000)] + [w + "=" + "Ab1" * 4 for w in ("password", "passwd", "secret", "api_key", "token")] + ["a1" * 20, "AKIA" + "Z" * 16, "1.2.3.4", "a@b.c"]
    for t in [*odd_texts, *(r.text or "" for r in docs.collect())]:
        for m in finds.finditer(t):
            assert hint.search(t), (t, m)


@pytest.fixture
def many_tasks(spark):
    """64 shuffle partitions that stay apart."""
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_small_shards_need_one_manifest_file_and_few_readers(docs, many_tasks):
    folder, manifest = tokenfile.write_ids(docs)
    assert manifest.count() > 32 and len(manifest.inputFiles()) == 1
    back = tokenfile.read_ids(folder, manifest)
    assert back.rdd.getNumPartitions() == 1 and back.count() == docs.count()


def test_small_tables_are_written_in_few_files(monkeypatch, spark, docs, many_tasks):
    made, fresh = [], _store.fresh_path
    monkeypatch.setattr(_store, "fresh_path", lambda spark, name: made.append(fresh(spark, name)) or made[-1])
    want = {r.doc_id: r.component_id for r in simhash.simhash_report(docs).collect()}
    files = [len(spark.read.parquet(p).inputFiles()) for p in made]
    assert len(files) > 20 and max(files) <= 4, dict(zip(made, files, strict=True))
    monkeypatch.setattr(_store, "dense", lambda df, rows: df)
    assert {r.doc_id: r.component_id for r in simhash.simhash_report(docs).collect()} == want


def test_large_tables_are_written_by_all_tasks(monkeypatch, spark):
    monkeypatch.setattr(_store, "FILE_ROWS", 10)
    many = spark.range(0, 95, 1, 32)
    assert [_store.dense(many, n).rdd.getNumPartitions() for n in (0, 10, 95, 10**6, 10**30)] == [1, 1, 10, 32, 32]


@pytest.fixture
def made(monkeypatch):
    """The paths of the tables staged from now on, by Spark's writers those with a _SUCCESS."""
    paths, fresh = [], _store.fresh_path
    monkeypatch.setattr(_store, "fresh_path", lambda spark, name: paths.append(fresh(spark, name)) or paths[-1])
    return paths


def _by_spark(paths):
    return [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in paths if os.path.exists(f"{p.removeprefix('file://')}/_SUCCESS")]


def test_tables_of_few_rows_need_no_process_for_a_file(monkeypatch, docs, made):
    want = sorted(map(str, simhash.representatives(docs).collect()))
    assert len(made) > 20 and _by_spark(made) == ["simhash-docs"]
    monkeypatch.setattr(_store, "BROADCAST_ROWS", -1)
    made.clear()
    assert sorted(map(str, simhash.representatives(docs).collect())) == want
    assert len(_by_spark(made)) == len(made) > 20


def test_tables_written_by_the_driver_come_back_whole(spark, made):
    kinds = "a bigint, b struct<x: bigint, y: string>, c int, d double, e binary, f boolean"
    rows = [(-(2**63), (2**63 - 1, "\ud7ff\U0010ffff"), 1, float("inf"), b"\x00", True), (None, None, None, None, None, None), (0, (None, ""), 2, -0.0, b"", False)]
    for some in (rows, []):
        df = spark.createDataFrame(some, kinds)
        back = _store.stage(df, "few", len(some))
        assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    days = spark.sql("SELECT INTERVAL '1' DAY AS i, map(1, 2) AS m")
    assert _store.stage(days, "odd", 1).collect() == days.collect()
    assert _by_spark(made) == ["odd"]


def test_paths_that_only_spark_reaches_are_left_to_it(spark):
    assert _store._folder(spark, "viewfs://store/shared/x") is None and _store._folder(spark, "shared/x") is None
    assert [_store._folder(spark, p)[1] for p in ("/shared/x", "file:/shared/x", "file:///shared/x")] == ["/shared/x"] * 3
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    was = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store")
    try:
        assert _store._folder(spark, "/shared/x") is None
    finally:
        conf.set("fs.defaultFS", was)


def test_the_few_keys_that_are_left_are_written_by_few_tasks(monkeypatch, spark, docs, made):
    monkeypatch.setattr(_store, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(_store, "FILE_ROWS", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "8k")
    try:
        simhash.representatives(docs).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    files = [len(spark.read.parquet(p).inputFiles()) for p in made if "simhash-centres" in p or "simhash-met" in p]
    assert files == [1, 1]


def test_tables_of_few_blocks_need_no_process_for_a_file(monkeypatch, docs, odd):
    paths, fresh = [], _store.fresh_path
    monkeypatch.setattr(_store, "fresh_path", lambda spark, name: paths.append(fresh(spark, name)) or paths[-1])
    want = [sorted(map(str, mixing.draw(x).collect())) for x in (docs, odd)]
    assert _by_spark(paths) == ["mix-rows", "mix-tree", "mix-dealt"] * 2
    monkeypatch.setattr(_store, "BROADCAST_ROWS", -1)
    assert [sorted(map(str, mixing.draw(x).collect())) for x in (docs, odd)] == want
