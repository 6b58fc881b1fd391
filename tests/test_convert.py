import json

from pyspark.sql import functions as F

from scriptorium.operators import convert, quality, serp
from scriptorium.streaming import control
from tests.test_control import events


def test_html_body():
    text = "# A *b*\n\n- x\n> q\n---\n|a|b|\n|-|-|\n|1|2|\nend\n```py\na<b\n```"
    assert convert.html_body(text).split("\n") == [
        "<h1>A <em>b</em></h1>", "", "<li>x</li>", "<blockquote>q</blockquote>", "<hr>", "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody>",
        "<tr><td>1</td><td>2</td></tr>", "</tbody></table>", "<p>end</p>", '<pre><code class="language-py">', "a&lt;b", "</code></pre>",
    ]
    assert convert.html_body(None) == ""


def test_diff():
    assert convert.diff("a\nb", "a\nc").split("\n")[2:] == ["@@ -1,2 +1,2 @@", " a", "-b", "+c"]
    assert convert.diff("a", "a") == ""


def test_search_pages_and_answers(spark):
    bing = '<li class="b_algo"><h2><a href="https://x.org/1">One <b>title</b></a></h2><p>words</p></li><li class="b_algo">none</li>'
    duck = '<a rel="n" class="result__a" href="//d.com/l/?uddg=https%3A%2F%2Fy.org%2F&x=1">Two</a> <a class="result__snippet" href="z">sn</a>'
    answer = json.dumps({"data": {"webPages": {"value": [{"name": "n", "url": "u", "summary": "", "snippet": "s"}]}}})
    df = spark.createDataFrame([(bing, duck, answer)], "bing string, duck string, answer string")
    row = df.select(serp.bing_rows(F.col("bing")), serp.duck_rows(F.col("duck")), serp.api_rows(F.col("answer"), "bocha"), serp.api_rows(F.lit("junk"), "serper")).first()
    assert [tuple(x) for x in row[0]] == [("https://x.org/1", "One title", "words")]
    assert [tuple(x) for x in row[1]] == [("https://y.org/", "Two", "sn")]
    assert [(x.title, x.url, x.snippet) for x in row[2]] == [("n", "u", "s")] and row[3] is None


def test_topic_tokens():
    assert quality.topic_tokens(["Kafka 消息队列 of the stream"]) == (sorted({"kafka", "stream", "消息", "息队", "队列"}), ["kafka"])
    assert quality.topic_tokens(["的 of"]) == ([], [])


def test_cache_and_health(spark):
    rows = [(i, "p", k, s) for i, (k, s) in enumerate([("a", 0), ("b", 1), ("a", 2), ("c", 3), ("b", 4), ("a", 50)])]
    df = spark.createDataFrame(rows, "id long, p string, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = control.lru_hits(df, "p", "k", "ts", ["id"], 2, 40.0).orderBy("id").collect()
    assert [r.hit for r in out] == [False, False, True, False, False, False]
    ok = [False, False, True, False, False, False, True]
    out = control.provider_health(events(spark, range(7), ok), "key", ["ts", "id"], "ok").orderBy("id").collect()
    assert [r.healthy for r in out] == [True, True, True, True, True, False, True]
