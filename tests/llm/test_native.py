import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.llm import chat, decontam, urls

EVIL = "a\\0b\\1<s>[INST]</s>\\\\ [TURN]<<SYS>>[SAYS]\\2"


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def read_back(df):
    out = {}
    for r in df.select("conv_id", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("l")).collect():
        out[r["conv_id"]] = ([(x["role"], x["text"]) for x in r["t"]], r["l"], r["formatted"])
    return out


def test_chat_round_trip_with_controls_nulls_other_roles_and_repeats(spark):
    rows = [
        (1, 0, "system", EVIL), (1, 1, "user", None), (1, 2, "assistant", EVIL), (1, 2, "assistant", EVIL), (1, None, "tool[x]<\\", "t\n"),
        (2, 0, None, ""), (None, 0, "user", "x"), (3, 0, "user", "y" * 300_000),
    ]
    df = chat.format_chats(turns(spark, rows).withColumn("formatted", F.lit(1)).withColumn("_turns", F.lit(2)))
    got = read_back(df)
    assert got[1][0] == [("tool[x]<\\", "t\n"), ("system", EVIL), ("user", ""), ("assistant", EVIL), ("assistant", EVIL)]
    assert got[1][1] == EVIL + EVIL and got[2][0] == [("", "")] and got[None][0] == [("user", "x")] and len(got[3][0][0][1]) == 300_000


def test_chat_automaton(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u"), (3, 1, "user", "u"), (4, 0, "system", "s")]
    got = {r["conv_id"]: (r["valid"], r["first_bad_turn"], r["final_state"]) for r in chat.format_chats(turns(spark, rows)).collect()}
    assert got == {1: (True, None, "assistant"), 2: (False, 0, "bad"), 3: (False, 1, "bad"), 4: (False, None, "system")}


def test_chat_empty_and_template_rules(spark):
    assert chat.format_chats(turns(spark, [])).count() == 0
    with pytest.raises(ValueError):
        chat.ChatTemplate(marks={"user": ("USER:", "</u>")})


URLS = [
    (1, "http://a.example.net/en/1"), (2, "https://EXAMPLE.net/en/"), (3, "http://example.net/EN/"), (4, "http://x.net"), (5, "http://x.net?/en/"), (6, None), (7, "no scheme/net/"),
    (8, "http://example.com/de/1#x"), (9, "http://notexample.com/de/1"), (10, "http://a.b.org/fr/"), (11, "ftp://a..net/"), (12, "http://net/"), (12, "http://net/"), (13, "://org/fr/x?y"), (14, ""), (15, "http://u:p@x.net:80/"),
    (16, "http://" + "a." * 3000 + "net/" + "b/" * 3000), (17, "x://http://example.net/en/"),
]


def test_urls_equal_sql(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("_h", F.lit(1)).withColumn("html", F.lit(None).cast("string"))
    got = sorted(tuple(r) for r in urls.judge_urls(pages, urls.rules_frame(spark, urls.QUERY_RULES)).select("page_id", "host", "path", "rule", "verdict").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", URLS)
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.OP10_SQL})").fetchall())
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    by = {r[0]: r[3:] for r in got}
    assert by[1] == ("example.net/en/", "allow") and by[3] == ("net/", "block") and by[4] == (None, "allow") and by[15] == (None, "allow") and by[16] == ("net/", "block")


def test_rules_inside_segments_ties_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/dead/x"), (2, "http://a.b/dx")], "page_id long, url string")
    rules = urls.rules_frame(spark, [("block", "b", "/de"), ("allow", "b", "/de"), ("block", "b", "/d"), ("allow", "a.b", "")])
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {1: ("b/de", "block"), 2: ("a.b", "allow")}
    assert {r["verdict"] for r in urls.judge_urls(pages, urls.rules_frame(spark, [])).collect()} == {"allow"}
    assert urls.judge_urls(pages.where("false"), rules).count() == 0


def brute(docs, items, k=5):
    def sh(t):
        w = (t or "").encode().lower().decode("utf-8", "surrogatepass").split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = {}
    for i, t in items:
        s = sh(t)
        for d, x in docs:
            if s and (n := len(s & sh(x))) >= 0.8 * len(s) - 1e-9:
                out[d, i] = max(out.get((d, i), (0, 0)), (n / len(s), n))
    return {k: v[1] for k, v in out.items()}


@pytest.mark.parametrize("limit", [decontam.BROADCAST_ROWS, 0])
def test_decontamination_equals_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    import random

    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([3, 5, 6, 9, 14, 30, 60]))) for i in range(40)] + [(40, None), (41, ""), (3, text(12))]
    docs = []
    for d in range(120):
        words = text(r.choice([0, 4, 5, 20, 200])).split()
        body = (items[r.randrange(43)][1] or "").upper().split()
        for _ in range(r.randrange(3)):
            if body:
                body[r.randrange(len(body))] = "changed"
        at = r.randrange(len(words) + 1)
        docs.append((d, " ".join(words[:at] + body + words[at:])))
    docs += [(1000, None), (1001, ""), (5, docs[5][1]), (1002, " ".join(t for _, t in items if t) * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_hash", F.lit(1)).withColumn("item_id", F.lit(2))
    got = {(x["doc_id"], x["item_id"]): x["n_shared"] for x in decontam.find_contained(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and len(got) > 30
    kept = decontam.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {x["doc_id"] for x in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got} and kept.columns == df.columns


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contained(docs, items).count() == 0
    assert decontam.decontaminate(docs.where("false"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_digest_of_the_added_conversation():
    said = "</s>[INST] ok [/INST]"
    assert hashlib.sha256(said.encode()).hexdigest() == hashlib.sha256(chat.ADDED[1][3].encode()).hexdigest()
