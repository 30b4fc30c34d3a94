"""Keys, thresholds, payloads and maintenance rules on small literal rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlake import schema as S
from answerlake.functions import text as X
from answerlake.functions import vectors as V
from answerlake.functions.ranking import COSINE, Gate, scale_threshold
from answerlake.operators import embed as E
from answerlake.operators import maintain as M
from answerlake.runtime import cut_lineage, few_rows
from answerlake.operators.shaping import blacklist_filter, mm_key, validate_requests
from answerlake.plans.cache_lookup import cache_lookup
from answerlake.plans.requests import handle_requests
from answerlake.sources import requests as Q
from answerlake.sources import tables as TB
from answerlake.sources import vectors as VB

QUERY = "query array<struct<role:string,content:string>>"


def one(df):
    return df.collect()[0]


def test_keys(spark):
    df = spark.createDataFrame([([("user", "a"), ("assistant", None), ("user", "b###c")],)], QUERY)
    r = one(df.select(X.last_content(F.col("query")).alias("last"), X.with_role(F.col("query")).alias("role"),
                      X.all_content(F.col("query")).alias("all"),
                      X.multi_splicing(F.col("query")).alias("spliced")))
    assert (r.last, r.role, r["all"]) == ("b###c", "user: b###c", "a\n\nb###c")
    assert r.spliced == "user###a|||assistant###|||user###b###c"


def test_split_dialog(spark):
    df = spark.createDataFrame([("user###a|||assistant###|||user###b###c|||plain",)], "key string")
    parts = one(df.select(X.dialog_parts(F.col("key")).alias("p"))).p
    assert [(p.role, p.content) for p in parts] == [
        ("user", "a"), ("assistant", None), ("user", "b###c"), (None, "exception")]


def test_without_prompt(spark):
    df = spark.createDataFrame([("be kind. tell me",)], "t string")
    assert one(df.select(X.without_prompt(F.col("t"), ["be kind\\. "]).alias("k"))).k == "tell me"
    assert one(df.select(X.without_prompt(F.col("t"), None).alias("k"))).k == "be kind. tell me"


@pytest.mark.parametrize("threshold, factor, cut", [
    (0.95, 1.0, 3.8), (0.95, 2.0, 4.0), (0.5, 0.5, 1.0), (0.5, -1.0, 0.0)])
def test_threshold_scale(spark, threshold, factor, cut):
    df = spark.range(1).select(scale_threshold(F.lit(threshold), cache_factor=factor).alias("c"))
    assert one(df).c == pytest.approx(cut)


def test_gate_rejects_bad_settings():
    with pytest.raises(ValueError):
        Gate(threshold=1.5)
    with pytest.raises(ValueError):
        Gate(metric="dot")
    assert COSINE.threshold == 0.9


ENTRIES = "model string, question string, answer string, embedding array<double>"


def entries(spark, rows):
    return M.new_entries(spark.createDataFrame(rows, ENTRIES))


def test_lookup_rules(spark):
    """Deleted entries, other tenants and long keys."""
    e = entries(spark, [("m", "q1", "a1", [1.0, 0.0]), ("m", "q2", "a2", [0.0, 1.0]),
                        ("n", "q3", "a3", [1.0, 1.0])])
    e = e.withColumn("is_deleted", F.col("question") == "q2")
    near = [0.99, float(np.sqrt(1 - 0.99 ** 2))]
    asked = spark.createDataFrame(
        [("r1", "m", "k", [1.0, 0.0]), ("r2", "m", "k", [0.0, 1.0]), ("r3", "n", "k", [1.0, 0.0]),
         ("r4", "m", "k" * 300, near), ("r5", "m", "k" * 256, near), ("r6", "none", "k", near)],
        "request_id string, model string, key string, embedding array<double>")
    gate = Gate(threshold=0.9, threshold_long=0.999)
    for method in ("scan", "tiles"):
        got = {r.request_id: (r.cache_hit, r.answer) for r in
               cache_lookup(asked, e, gate, method=method).collect()}
        assert got == {"r1": (True, "a1"), "r2": (False, ""), "r3": (False, ""), "r4": (False, ""),
                       "r5": (True, "a1"), "r6": (False, "")}


def test_empty_tables(spark):
    e = entries(spark, [("m", "q1", "a1", [1.0, 0.0])]).where("false")
    asked = spark.createDataFrame([("r1", "m", "k", [1.0, 0.0])],
                                  "request_id string, model string, key string, embedding array<double>")
    for method in ("scan", "tiles"):
        assert [r.cache_hit for r in cache_lookup(asked, e, method=method).collect()] == [False]
        assert cache_lookup(asked.where("false"), e, method=method).count() == 0
    assert M.check_evict(e).count() == 0


def test_parse_broken_and_partial_lines(spark):
    lines = spark.createDataFrame([('{"type": "query", "scope": {"model": "a-b.c"}}',), ("{oops",), ("[]",)],
                                  "value string")
    rows = Q.parse_requests(lines).collect()
    assert [r.error_code for r in rows][:2] == [0, 400]
    assert rows[0].raw_model == "a-b.c" and rows[0].query is None


def test_validation_and_blacklist(spark):
    df = spark.createDataFrame(
        [("query", "a-b.c", None), ("x", "m", None), (None, "m", None), ("query", None, None),
         ("remove", "m", None), ("remove", "m", "delete_by_id"), ("insert", "DI_COPILOT-LAB", None),
         ("query", "DI_COPILOT_THIRD", None), ("register", "DI_COPILOT_SECOND", None)],
        "type string, raw_model string, remove_type string")
    verbs = Q.parse_requests(spark.createDataFrame([('{"type":"bogus"}',), ('{"type":"bogus","scope":{}}',), ('{"type":"query"}',)],
                                                   "value string"))
    assert [r.error_code for r in validate_requests(verbs).collect()] == [102, 103, 103]
    rows = blacklist_filter(validate_requests(df)).collect()
    assert [r.error_code for r in rows] == [0, 102, 102, 103, 401, 0, 305, 105, 0]
    assert rows[0].model == "a_b_c"


def test_mm_key(spark):
    df = spark.createDataFrame(
        [(["a", "b"], "raw", None, "IMG_TEXT"), (["a"], "raw", "url", "IMG_TEXT"),
         (["a"], "", "", "IMG_TEXT"), (["a"], None, None, "TEXT"), (["a"], None, "u", "IMG")],
        "text array<string>, imageRaw string, imageUrl string, multiType string")
    rows = mm_key(df).collect()
    assert [(r.key, r.image, bool(r.error_desc)) for r in rows] == [
        ("a###b", "raw", False), ("a", None, True), ("a", None, True), ("a", None, False), ("a", None, True)]
    empty = spark.createDataFrame([([""], None, None)], "text array<string>, imageRaw string, imageUrl string")
    assert one(mm_key(empty, insert=True)).error_desc != ""


def test_normalize_answers(spark):
    df = spark.createDataFrame([("a", None, None), (None, ["b", "c"], None), (None, None, [("d", 1), ("e", None)])],
                               "t string, ts array<string>, p array<struct<answer:string,answer_type:int>>")
    rows = df.select(Q.normalize_answers(F.col("t"), F.col("ts"), F.col("p")).alias("x")).collect()
    assert [[(a.answer, a.answer_type) for a in r.x] for r in rows] == [
        [("a", 0)], [("b", 0), ("c", 0)], [("d", 1), ("e", 0)]]


def test_vector_bytes(spark):
    v = np.array([0.5, -2.0, 3.25], dtype="<f4")
    df = spark.createDataFrame([(1, bytearray(v.tobytes())), (2, bytearray(b"short")), (3, None)],
                               "id int, v binary")
    got = {r.id: r.v for r in VB.decode_vectors(df, "v", 3).collect()}
    assert got == {1: [0.5, -2.0, 3.25], 2: None, 3: None}


def test_zero_vectors_are_rejected(spark):
    rows = spark.createDataFrame([("m", "q", "a", [0.0, 0.0]), ("m", "p", "a", [3.0, 4.0])], ENTRIES)
    assert [r.question for r in M.new_entries(rows).collect()] == ["p"]
    assert [r.question for r in M.rejected_vectors(rows).collect()] == ["q"]
    assert one(rows.where("question = 'p'").select(V.l2_normalize(F.col("embedding")).alias("v"))).v == [0.6, 0.8]


def test_insert_twice_changes_nothing(spark):
    rows = spark.createDataFrame([("m", "q", "a", [1.0, 2.0]), ("m", "p", "a", [3.0, 4.0])], ENTRIES)
    base = M.new_entries(rows.limit(0))
    once = M.insert_entries(base, rows)
    assert once.count() == 2 and M.insert_entries(once, rows).count() == 2


def test_check_evict_limits(spark):
    e = spark.range(100).selectExpr("if(id < 50, 'a', 'b') as model", "id in (1, 2, 3, 4, 5, 60) as is_deleted")
    got = {r.model: r.purge for r in M.check_evict(e).collect()}
    assert got == {"a": False, "b": False}
    got = {r.model: r.purge for r in M.check_evict(e, max_marked=4).collect()}
    assert got == {"a": True, "b": False}


def test_register(spark):
    wanted = spark.createDataFrame([("a", None), ("b", "mm"), ("", None)], "model string, mm_type string")
    known = spark.createDataFrame([("a", None, 8, "l2")], "model string, mm_type string, dim int, metric string")
    status, after = M.register_collections(wanted, known, 16)
    assert {(r.model, r.response, r.error_code) for r in status.collect()} == {
        ("a", "already_exists", 0), ("b", "create_success", 0), ("", None, 502)}
    assert {(r.model, r.dim) for r in after.collect()} == {("a", 8), ("b", 16)}


def test_embed_with_loads_once_per_task(spark):
    def load():
        calls = {"n": 0}

        def model(texts):
            calls["n"] += 1
            return np.array([[len(t), calls["n"]] for t in texts], dtype=np.float32)
        return model

    df = spark.createDataFrame([("ab",), ("c",)], "t string").coalesce(1)
    assert sorted(tuple(r.embedding) for r in E.embed_with(df, "t", load, 2).collect()) == [(1.0, 1.0), (2.0, 1.0)]
    with pytest.raises(Exception, match="expected dim 3"):
        E.embed_with(df, "t", load, 3).collect()


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_token_mean_by_broadcast_and_by_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(E, "VECTOR_BYTES", limit)
    docs = spark.createDataFrame([(1, "the cat the"), (2, " The\ndog "), (3, ""), (4, None), (5, "no such words"),
                                  (6, "no such the")], "id long, text string")
    vec = spark.createDataFrame([("the", [1.0, 0.0]), ("cat", [4.0, 3.0]), ("dog", [0.0, 1.0])],
                                "token string, vec array<double>")
    got = {r.id: r.embedding for r in E.embed_token_mean(docs, "id", "text", vec, 2).collect()}
    assert got == {1: pytest.approx([2.0, 1.0]), 2: pytest.approx([0.5, 0.5]), 3: None, 4: None, 5: None,
                   6: pytest.approx([1.0, 0.0])}
    long = {r.id: r.embedding for r in E.embed_long_windowed(docs, "id", "text", vec, 2, window=2).collect()}
    assert long == {1: pytest.approx([(2.5 + 1) / 2, 1.5 / 2]), 2: pytest.approx([0.5, 0.5]), 3: None, 4: None, 5: None,
                    6: pytest.approx([1.0, 0.0])}
    assert E.embed_token_mean(docs.limit(0), "id", "text", vec, 2).count() == 0
    assert E.embed_token_mean(docs, "id", "text", vec.limit(0), 2).where("embedding is not null").count() == 0


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_means_at_real_width(spark, monkeypatch, limit):
    """768 dimensions, sums cut by batches and slices, against numpy."""
    monkeypatch.setattr(E, "VECTOR_BYTES", limit)
    monkeypatch.setattr(E, "SLICE_CELLS", 768 * 7)
    r = np.random.default_rng(5)
    table = {f"t{i}": r.standard_normal(768) for i in range(40)}
    texts = {i: [f"t{k}" for k in r.integers(0, 44, size=int(r.integers(1, 60)))] for i in range(60)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string").repartition(3)
    vec = spark.createDataFrame([(t, v.tolist()) for t, v in table.items()], "token string, vec array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        one = {x.id: x.embedding for x in E.embed_token_mean(docs, "id", "text", vec, 768).collect()}
        long = {x.id: x.embedding for x in E.embed_long_windowed(docs, "id", "text", vec, 768, window=7).collect()}
        rows = docs.select("id", F.explode(F.split("text", " ")).alias("token")).join(vec, "token").withColumn(
            "mask", F.when(F.col("token") < "t3", 1).otherwise(0))
        masked = {x.id: x.embedding for x in E.embed_masked_mean(rows, "id", 768).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, words in texts.items():
        known = [table[t] for t in words if t in table]
        windows = [m for s in range(0, len(words), 7) if (m := [table[t] for t in words[s:s + 7] if t in table])]
        if not known:
            assert one[i] is None and long[i] is None and i not in masked
            continue
        assert np.allclose(one[i], np.mean(known, axis=0))
        assert np.allclose(long[i], np.mean([np.mean(w, axis=0) for w in windows], axis=0))
        low = [table[t] for t in words if t in table and t < "t3"]
        assert np.allclose(masked[i], np.sum(low, axis=0) / max(len(low), 1e-9) if low else 0)


def test_tenant_folders_are_pruned_and_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "entries")
    e = entries(spark, [("m", "q1", "a1", [1.0, 0.0]), ("n", "q2", "a2", [0.0, 1.0])])
    TB.write_entries(e, path)
    TB.write_entries(entries(spark, [("n", "q3", "a3", [0.0, 1.0])]), path)
    assert sorted(r.question for r in TB.read_entries(spark, path).collect()) == ["q1", "q3"]
    plan = TB.read_entries(spark, path, ["m"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan or "PartitionFilters: [(model" in plan


@pytest.mark.parametrize("kind", ["VARCHAR", "INTEGER"])
def test_every_id_meets_one_jdbc_slice(kind):
    import duckdb

    ids = [str(i) for i in range(1, 3000)] if kind == "INTEGER" else [
        "", "0", "00", "0f", "9", "A1", "Ff", "ff", "fff", "g", "z", "~", "\u00e9", " x", "-", *map(str, range(300)),
        *(f"{i:02x}aa" for i in range(256))]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t (id {kind})")
    con.executemany("INSERT INTO t VALUES (?)", [(i,) for i in ids] + [(None,)])
    slices = TB.jdbc_slices()
    assert sum(con.execute(f"SELECT count(*) FROM t WHERE {s}").fetchall()[0][0] for s in slices) == len(ids) + 1
    once = " + ".join(f"CASE WHEN {s} THEN 1 ELSE 0 END" for s in slices)
    assert con.execute(f"SELECT min(n), max(n) FROM (SELECT {once} AS n FROM t)").fetchall() == [(1, 1)]


@pytest.mark.parametrize("method", ["scan", "tiles"])
def test_bad_vectors_leave_good_lookups_alone(spark, method):
    bad = [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], None
    stored = [(f"e{i}", "m", f"q{i}", "a", v, False) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], *bad])]
    entries = spark.createDataFrame(stored, "id string, model string, question string, answer string, "
                                    "embedding array<float>, is_deleted boolean").coalesce(1)
    asked = [(f"r{i}", "m", "k", v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], *bad])]
    requests = spark.createDataFrame(asked, "request_id string, model string, key string, "
                                     "embedding array<float>").coalesce(1)
    got = {r.request_id: r.hit_id for r in cache_lookup(requests, entries, method=method).collect()}
    assert got == {"r0": "e0", "r1": "e1", "r2": None, "r3": None, "r4": None, "r5": None}
    units = requests.select("request_id", V.l2_normalize(F.col("embedding")).alias("v")).collect()
    assert {r.request_id for r in units if r.v is not None} == {"r0", "r1"}


def test_bytes_of_bad_vectors_are_null(spark):
    raw = [np.array(v, "<f4").tobytes() for v in ([1, 2, 3], [np.nan, 0, 0], [np.inf, 0, 0])] + [b"123", None]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, v binary").coalesce(1)
    back = VB.decode_vectors(df, "v", 3)
    assert {r.id: r.v for r in back.collect()} == {0: [1, 2, 3], 1: None, 2: None, 3: None, 4: None}
    assert {r.id: r.v for r in VB.encode_vectors(back, "v").collect()} == {0: raw[0], 1: None, 2: None, 3: None, 4: None}


def test_insert_after_delete_is_live_again(spark):
    rows = spark.createDataFrame([("m", "q", "a", [1.0, 0.0])], "model string, question string, answer string, "
                                 "embedding array<double>")
    once = M.insert_entries(M.new_entries(rows).limit(0), rows)
    dead = M.soft_delete(once, once.select("id"))
    again = M.insert_entries(dead, rows).collect()
    assert len(again) == 1 and not again[0].is_deleted
    assert M.insert_entries(once, rows).count() == 1


def test_ids_of_images_with_one_text(spark):
    rows = spark.createDataFrame([("m", "q", "a", k, u, i) for k, u, i in [
        ("IMG", "u1", None), ("IMG", "u2", None), ("IMG", None, "u1"), ("IMG", "u1", None), (None, None, None)]],
        "model string, question string, answer string, mm_type string, image_url string, image_id string")
    ids = [r.id for r in M.assign_ids(rows).collect()]
    assert len(set(ids)) == 4 and ids[0] == ids[3]
    assert ids[4] == M.assign_ids(rows.select("model", "question", "answer")).first().id


def test_batch_answers_every_line(spark):
    """Null and repeated ids, a key without a vector, rejected pairs, truncate before insert."""
    def embed(rows):
        return rows.where("key not like '%unknown%'").withColumn("embedding", F.array(
            F.when(F.col("key").contains("zero"), 0.0).otherwise(1.0), F.lit(0.0)))

    ask = lambda text, i=None: {"type": "query", "scope": {"model": "m"}, "query": [{"role": "user", "content": text}],
                                **({"requestId": i} if i else {})}
    put = lambda *texts: {"type": "insert", "scope": {"model": "m"}, "chat_info": [
        {"query": [{"role": "user", "content": t}], **({"answer": "a"} if t != "mute" else {})} for t in texts]}
    lines = [ask("hello"), ask("hello", "x"), ask("hello", "x"), ask("unknown"), put("hello"), put("hello", "mute", "zero"),
             {"type": "remove", "scope": {"model": "m"}, "remove_type": "truncate_by_model"}]
    requests = Q.parse_requests(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string"))
    rows = spark.createDataFrame([("m", "user: hello", "a", [1.0, 0.0])], "model string, question string, "
                                 "answer string, embedding array<double>")
    stored = M.new_entries(rows)
    known = spark.createDataFrame([("m", None, 2, "l2")], "model string, mm_type string, dim int, metric string")
    out = handle_requests(requests, stored, known, embed, 2)
    got = out.responses.collect()
    assert len(got) == len(lines)
    assert sorted((str(r.request_id), r.cache_hit) for r in got if r.cache_hit) == [("None", True), ("x", True), ("x", True)]
    assert sorted((r.error_code, r.error_desc) for r in got if r.error_code) == [(302, "2 of 3 pairs not inserted")]
    assert out.log.count() == 4
    assert [(r.question, r.is_deleted) for r in out.entries.collect()] == [("user: hello", False)]


def test_request_batch(spark):
    """One batch of every verb, with hit counts, removal and insert."""
    words = {"hello": [1.0, 0.0], "bye": [0.0, 1.0]}

    def embed(rows):
        out = F.array(F.lit(1.0), F.lit(1.0))
        for w, v in words.items():
            out = F.when(F.col("key").contains(w), F.array(*[F.lit(x) for x in v])).otherwise(out)
        return rows.withColumn("embedding", out)

    stored = entries(spark, [("m_1", "user: hello", "hi", [1.0, 0.0]), ("t", "user: bye", "bye", [0.0, 1.0])])
    gone = [r.id for r in stored.where("model = 'm_1'").collect()]
    body = lambda **kw: __import__("json").dumps(kw)
    ask = [{"role": "user", "content": "hello there"}]
    lines = [
        body(requestId="1", type="query", scope={"model": "m-1"}, query=ask),
        body(requestId="2", type="query", scope={"model": "m-1"}, query=[{"role": "user", "content": "bye"}]),
        body(requestId="3", type="insert", scope={"model": "m-1"},
             chat_info=[{"query": [{"role": "user", "content": "bye"}], "answer": "see you"}]),
        body(requestId="4", type="remove", scope={"model": "m-1"}, remove_type="delete_by_id", id_list=gone),
        body(requestId="5", type="remove", scope={"model": "t"}, remove_type="truncate_by_model"),
        body(requestId="6", type="register", scope={"model": "new"}),
        body(requestId="7", type="query", scope={"model": "m-1"}),
        "{broken"]
    requests = Q.parse_requests(spark.createDataFrame([(x,) for x in lines], "value string"))
    known = spark.createDataFrame([("t", None, 2, "l2")], "model string, mm_type string, dim int, metric string")
    out = handle_requests(requests, stored, known, embed, 2)
    got = {r.request_id: (r.error_code, r.cache_hit, r.answer, r.status) for r in out.responses.collect()}
    assert got == {"1": (0, True, "hi", ""), "2": (0, False, "", ""), "3": (0, False, "", "success"),
                   "4": (0, False, "", "success"), "5": (0, False, "", "success"),
                   "6": (0, False, "", "create_success"), "7": (201, False, "", ""),
                   None: (400, False, "", "")}
    after = {(r.model, r.question): (r.hit_count, r.is_deleted) for r in out.entries.collect()}
    assert after == {("m_1", "user: hello"): (1, True), ("m_1", "user: bye"): (0, False)}
    assert sorted(r.request_id for r in out.log.collect()) == ["1", "2", "7"]
    assert {r.model for r in out.collections.collect()} == {"t", "m_1", "new"}
    assert S.BLACKLIST


@pytest.mark.parametrize("method", ["scan", "tiles"])
@pytest.mark.parametrize("short, long", [(0.9, 0.95), (0.9, 0.8), (0.0, 0.5), (0.97, 0.97)])
def test_gates_of_several_candidates(spark, method, short, long):
    """Five candidates a request: first the best against the short threshold, then
    each against that of the key's length."""
    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    stored = unit(rng.normal(size=(60, 3))).astype(np.float32)
    asked = unit(rng.normal(size=(40, 3)))
    e = spark.createDataFrame([(f"e{i:02d}", "m", f"q{i}", f"a{i}", v.tolist(), False) for i, v in enumerate(stored)],
                              "id string, model string, question string, answer string, "
                              "embedding array<float>, is_deleted boolean")
    q = spark.createDataFrame([(f"r{i:02d}", "m", "k" * (300 if i % 2 else 9), v.tolist()) for i, v in enumerate(asked)],
                              "request_id string, model string, key string, embedding array<double>")
    want = {}
    for i, v in enumerate(asked):
        d2 = ((stored.astype(np.float64) - v) ** 2).sum(1)
        near = sorted((d, f"e{j:02d}") for j, d in enumerate(d2))[:5]
        rank = [(4 - min(d, 4), n) for d, n in near]
        if max(r for r, _ in rank) >= 4 * short:
            good = [n for r, n in rank if r >= 4 * (long if i % 2 else short)]
            if good:
                want[f"r{i:02d}"] = good
    got = {r.request_id: r.ids for r in cache_lookup(
        q, e, Gate(threshold=short, threshold_long=long), k=5, pick="all", method=method).collect()}
    assert len(got) == len(asked) and {r: ids for r, ids in got.items() if ids} == want


@pytest.mark.parametrize("method", ["scan", "tiles"])
def test_lookup_reads_only_the_tenants_of_the_batch(spark, tmp_path, method):
    path = str(tmp_path / "entries")
    rows = spark.createDataFrame([(m, f"q{m}", "a", [1.0, 0.0]) for m in ("m", "n", "o")],
                                 "model string, question string, answer string, embedding array<double>")
    TB.write_entries(M.new_entries(rows), path)
    asked = spark.createDataFrame([("r", "m", "k", [1.0, 0.0])],
                                  "request_id string, model string, key string, embedding array<float>")
    out = cache_lookup(asked, TB.read_entries(spark, path), method=method)
    assert [r.hit_query for r in out.collect()] == ["qm"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    texts = [x for x in plan.split("FileScan parquet")[1:] if "question" in x.split("Batched")[0]]
    assert texts and all("PartitionFilters: []" not in x for x in texts)


def test_lookup_with_a_callers_evaluator(spark):
    rows = spark.createDataFrame([("m", q, "a " + q, v) for q, v in [("near", [1.0, 0.0]), ("wanted", [0.99, 0.14])]],
                                 "model string, question string, answer string, embedding array<double>")
    asked = spark.createDataFrame([("r1", "m", "wanted", [1.0, 0.0]), ("r2", "m", "other", [1.0, 0.0])],
                                  "request_id string, model string, key string, embedding array<float>")
    scorer = F.when(F.col("question") == F.col("key"), 4.0).otherwise(0.0)
    entries = M.new_entries(rows)
    for pick in ("first", "random"):
        got = {r.request_id: r.hit_query for r in cache_lookup(asked, entries, k=2, pick=pick, scorer=scorer).collect()}
        assert got == {"r1": "wanted", "r2": ""}
    assert {r.hit_query for r in cache_lookup(asked, entries, k=2).collect()} == {"near"}


def test_exact_percentiles_over_many_ranges(spark):
    """Ranks across range borders, ties, null groups and values, against numpy."""
    import random

    import numpy as np

    from answerlake.operators.analytics import exact_percentiles

    r, rows = random.Random(4), []
    for g, n in (("a", 1), ("b", 2), ("c", 501), (None, 300), ("d", 0)):
        rows += [(g, r.choice([r.gauss(0, 1e6), 1.5, -3.0, 1e-300, float(r.randrange(5))])) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("c", None), ("e", None)], "g string, v double")
    for task_rows in (7, 1 << 20):
        got = {x.g: x for x in exact_percentiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.95, 1.0], task_rows).collect()}
        assert set(got) == {"a", "b", "c", None}
        for g, x in got.items():
            v = [y for k, y in rows if k == g]
            assert x.rows == len(v) and x.mean == pytest.approx(np.mean(v), rel=1e-9)
            assert x.p == pytest.approx(np.quantile(v, [0.0, 0.25, 0.5, 0.95, 1.0]).tolist(), rel=1e-12)
    assert exact_percentiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def _vectors_of(rows):
    """A vector for each image and each text, by their first letters."""
    letter = lambda c: (F.ascii(F.substring(c, 1, 1)).cast("double") - 64) / 8
    return (rows.withColumn("image_vec", F.when(F.col("image").isNotNull(), F.array(F.lit(1.0), letter("image"))))
            .withColumn("text_vec", F.when(F.col("key") != "", F.array(letter("key"), F.lit(1.0)))))


def test_multimodal_batch(spark):
    """Query, insert, remove, register, errors, raw images, hit counts, log and collections in one batch."""
    from answerlake.plans.mm_requests import handle_mm_requests, mm_entries

    def line(uuid, verb, model="m-1", **more):
        scope = {"scope": {"model": model}} if model else {}
        return json.dumps({"UUID": uuid, "request_type": verb, **scope, **more})

    part = lambda text, raw=None, url=None, kind=None: {"text": [text] if text else [], "imageRaw": raw, "imageUrl": url, "multiType": kind}
    pair = lambda p, a: {"chat_info": [{"query": part("ignored"), "answer": "x"}, {"query": p, "answer": a}]}
    parse = lambda lines: Q.parse_mm_requests(spark.createDataFrame([(x,) for x in lines], "value string"))
    stored = parse([line("s1", "insert", **pair(part("alpha", raw="Raw picture"), "one")),
                    line("s2", "insert", **pair(part("zeta"), "two")), line("s3", "insert", model="gone", **pair(part("q"), "three"))])
    rows, rejects = mm_entries(stored.withColumn("model", F.translate("raw_model", "-.", "__")), _vectors_of)
    assert rejects.count() == 0
    collections = spark.createDataFrame([("m_1", "mm", 4, "l2")], "model string, mm_type string, dim int, metric string")
    log = spark.createDataFrame([("m_1", 1.0), ("gone", 2.0)], "model string, delta_time double")
    out = handle_mm_requests(parse([
        line("q1", "query", query=part("alpha", raw="Raw picture", kind="IMG_TEXT")), line("q2", "query", query=part("zeta", kind="TEXT")),
        line("q3", "query", query=part("x", kind="OTHER")), line("q4", "query", query=part("0", kind="TEXT")),
        line("i1", "insert", **pair(part("same", raw="A image"), "ans")), line("i2", "insert", **pair(part("same", raw="B image"), "ans")),
        line("i3", "insert", **pair(part("", None, None), "ans")), line("i4", "insert"), line("i5", "insert", **pair(part("same", raw="A image"), "ans")),
        line("r1", "remove", model="gone", remove_type="truncate_by_model"), line("r2", "remove", remove_type="drop"),
        line("g1", "register", type="IMG_TEXT"), line("g2", "register", type="TEXT"), line("g3", "register", type="sound"),
        line("b1", "bogus"), line("b2", "bogus", model=None), "{broken", line("n", "query", model=None)]),
        cut_lineage(rows, "mm-stored"), collections, _vectors_of, 4, query_log=log)
    got = {r.request_id: r for r in out.responses.collect()}
    code = {i: (r.error_code, r.cache_hit, r.answer, r.status) for i, r in got.items()}
    assert code == {
        "q1": (0, True, "one", ""), "q2": (0, True, "two", ""), "q3": (201, False, "", ""), "q4": (0, False, "", ""),
        "i1": (0, False, "", "success"), "i2": (0, False, "", "success"), "i3": (301, False, "", "exception"),
        "i4": (301, False, "", "exception"), "i5": (0, False, "", "success"),
        "r1": (0, False, "", "success"), "r2": (401, False, "", ""),
        "g1": (0, False, "", "already_exists"), "g2": (0, False, "", "create_success"), "g3": (502, False, "", "exception"),
        "b1": (102, False, "", ""), "b2": (102, False, "", ""), None: (301, False, "", ""), "n": (103, False, "", "")}
    after = sorted((r.model, r.question, r.answer, r.hit_count) for r in out.entries.collect())
    assert after == [("m_1", "alpha", "one", 1), ("m_1", "same", "ans", 0), ("m_1", "same", "ans", 0), ("m_1", "zeta", "two", 1)]
    assert sorted(r.request_id for r in out.log.collect()) == ["b1", "b2", "q1", "q2", "q3", "q4"]
    assert {(r.model, r.mm_type) for r in out.collections.collect()} == {("m_1", "mm"), ("m_1", "text")}
    assert sorted((r.model or "", r.delta_time is not None) for r in out.query_log.collect()).count(("m_1", True)) >= 5
    assert out.query_log.where("model = 'gone'").count() == 0


def test_only_a_local_session_may_use_a_local_folder():
    from types import SimpleNamespace

    from answerlake.runtime import shared_dir

    for master, fine in (("local", True), ("local[8]", True), ("local[*,3]", True),
                         ("local-cluster[2,1,1024]", False), ("spark://host:7077", False)):
        kept = {}
        session = SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(
            get=lambda name, default=None: kept.get(name, default), set=kept.__setitem__))
        if fine:
            assert shared_dir(session, "x").startswith(kept["spark.checkpoint.dir"])
        else:
            with pytest.raises(RuntimeError):
                shared_dir(session, "x")


def test_large_token_table_holds_the_frequent_and_joins_the_rest(spark, monkeypatch):
    """Means are those of a table that every task holds, and only tokens not held leave their text."""
    from answerlake.operators import embed as E
    from answerlake.functions.text import tokens
    texts = ["a b a c", "z z a", "", None, "unknown", "a b c d e f g h a b", "q " + "a " * 40]
    docs = spark.createDataFrame([(i % 6, x) for i, x in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(w, [float(ord(w)), 1.0, -0.5 * ord(w)]) for w in "abcdefghqz"], "token string, vec array<double>")
    rows = lambda df: sorted((r[0], None if r[1] is None else [round(x, 9) for x in r[1]]) for r in df.collect())
    once = docs.where("doc_id > 0")
    want = rows(E.embed_token_mean(once, "doc_id", "text", table, 3)), rows(E.embed_long_windowed(once, "doc_id", "text", table, 3, 4))
    monkeypatch.setattr(E, "few_rows", lambda *a: False)
    for held in (1, 3, 100):
        monkeypatch.setattr(E, "HELD_ROWS", held)
        monkeypatch.setattr(E, "HELD_SHARE", 1)
        assert (rows(E.embed_token_mean(once, "doc_id", "text", table, 3)), rows(E.embed_long_windowed(once, "doc_id", "text", table, 3, 4))) == want
        left = E._token_sums(docs, "doc_id", tokens(F.col("text")), table, 3).groupBy("id").count().agg(F.sum("count")).first()[0]
        assert left == {1: 7 + 2 + 1 + 7 + 1, 3: 7 + 1 + 5 + 1, 100: 7}[held]


def test_batch_writes_payloads_of_their_verb_only(spark, monkeypatch):
    """Every line carries a query, pairs and ids; only what its verb reads is written."""
    from answerlake.plans import requests as plan
    written, cut = {}, plan.cut_lineage
    monkeypatch.setattr(plan, "cut_lineage", lambda df, name, *a: written.setdefault(name, cut(df, name, *a)))
    said = [{"role": "user", "content": "hello"}]
    load = {"query": said, "chat_info": [{"query": said, "answer": "a"}], "id_list": ["i"], "remove_type": "delete_by_id"}
    lines = [json.dumps({"requestId": verb, "type": verb, "scope": {"model": model}, **load})
             for model, verb in [("m", "query"), ("m", "insert"), ("m", "remove"), ("m", "register"), ("m", "bogus"),
                                 (S.BLACKLIST[0], "query")]]
    requests = Q.parse_requests(spark.createDataFrame([(x,) for x in lines], "value string"))
    stored = M.new_entries(spark.createDataFrame([("m", "user: hello", "b", [1.0, 0.0])], "model string, question string, "
                                                 "answer string, embedding array<double>"))
    known = spark.createDataFrame([("m", None, 2, "l2")], "model string, mm_type string, dim int, metric string")
    out = handle_requests(requests, stored, known, lambda r: r.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0))), 2)
    assert sorted((r.request_id, r.error_code, r.answer) for r in out.responses.collect()) == [
        ("bogus", 102, ""), ("insert", 0, ""), ("query", 0, "b"), ("query", 105, ""), ("register", 0, ""), ("remove", 0, "")]
    assert sorted(r.answer for r in out.entries.collect()) == ["a", "b"]
    held = {(r._given_id, r.model): tuple(r[c] is not None for c in ("query", "chat_info", "id_list"))
            for r in written["requests"].collect()}
    assert {k[0]: v for k, v in held.items() if any(v)} == {
        "query": (True, False, False), "insert": (False, True, False), "remove": (False, False, True)}
    assert sum(map(any, held.values())) == 3 and len(held) == len(lines)


def test_measuring_a_frame_moves_sizes_only(spark, monkeypatch):
    """What a limit lets through is shuffled to one task."""
    df = spark.range(40).select("id", F.array_repeat(F.lit(0.5), 8).alias("vec"), F.repeat(F.lit("x"), 100).alias("text"))
    seen, limit = [], type(df).limit
    monkeypatch.setattr(type(df), "limit", lambda self, n: seen.append([t for _, t in self.dtypes]) or limit(self, n))
    size = 16 + 8 + (64 + 8) + (100 + 8)
    assert few_rows(df, 40, 40 * size) and not few_rows(df, 39, 40 * size) and not few_rows(df, 40, 40 * size - 1)
    assert few_rows(df.limit(0), 0, 0)
    # the wide one is the empty frame's own
    assert [t for t in seen if set(t) != {"bigint"}] == [["bigint", "array<double>", "string"]]
