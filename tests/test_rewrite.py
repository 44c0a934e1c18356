import pytest
from pyspark.sql import functions as F

from gristmill.functions.rewrite import rewrite_text, rewritten, skip_reason

LOG = "\n".join(f"2024-01-01 10:00:{i:02d} worker {i} started" for i in range(12))
SAME = "\n".join(["connection lost, trying again"] * 12)
TRACE = "\n".join(["Traceback"] + ['  File "a.py", line 3, in f', "    f()"] * 6 + ["Error"])
DIFF = "\n".join(["@@ -1 +1 @@"] + [f" line {i}" for i in range(12)] + ["-x = 1", "+x = 1", "-y", "+z"])
LONG = "/srv/data/projects/alpha/releases/2024/builds/artifact.bin"

CASES = [
    ("log_collapse", "lite", SAME, "connection lost, trying again\n[... 10 identical lines collapsed ...]\nconnection lost, trying again"),
    ("log_collapse", "standard", LOG, LOG),
    ("log_collapse", "aggressive", LOG, "2024-01-01 10:00:00 worker 0 started\n[... 10 identical lines collapsed ...]\n2024-01-01 10:00:11 worker 11 started"),
    ("stack_trace", "lite", TRACE, "Traceback\n[... 6 identical frames collapsed ...]\nError"),
    ("diff_compactor", "standard", DIFF, "@@ -1 +1 @@\n line 0\n line 1\n[... 8 unchanged lines ...]\n line 10\n line 11\n-x = 1\n+x = 1\n-y\n+z"),
    ("diff_compactor", "aggressive", DIFF, "@@ -1 +1 @@\n line 0\n[... 10 unchanged lines ...]\n line 11\n-y\n+z"),
    ("caveman", "lite", "I really like the cat, just so.", "I like cat, so."),
    ("caveman", "standard", "Could you go there in order to see?", "go there to see?"),
    ("caveman", "ultra", "The function is very good and returns that.", "The fn good rets "),
    ("rtk", "minimal", "the function calls my_function at https://x.y/function", "the fn calls my_function at https://x.y/function"),
    ("rtk", "standard", "because something", "bc smth"),
    ("json_aware", "safe", ' {"b": 1,\n "a": [1, 2]} ', ' {"b":1,"a":[1,2]} '),
    ("json_aware", "standard", "a  \n\n\n\n\nb", "a\n\n\nb"),
    ("json_aware", "aggressive", '{"a": 1, // one\n "b": 2,}', '{"a":1,"b":2}'),
    ("json_collapse", "aggressive", str(list(range(40))), '[0, 1, 2, "[... 35 items omitted; types: int=35 ...]", 38, 39]'),
    ("comment_strip", "lite", "```python\n# gone\nx = 1  # stays\n```", "```python\nx = 1  # stays\n```"),
    ("comment_strip", "standard", '```js\nlet u = "http://a"; // gone\n```', '```js\nlet u = "http://a";\n```'),
    ("comment_strip", "aggressive", '```python\ndef f():\n    """Doc.\n    More."""\n    return 1\n```', "```python\ndef f():\n    return 1\n```"),
    ("comment_strip", "standard", "```py\ns = 'a # b' # gone\nt = \"it's\" # gone\nu = \"\\\"#\" # gone\n```", "```py\ns = 'a # b'\nt = \"it's\"\nu = \"\\\"#\"\n```"),
    ("comment_strip", "standard", "```js\na /* b */ + c; // see http://d\nurl = http://e\n#!run\n```", "```js\na  + c;\nurl = http://e\n#!run\n```"),
    ("comment_strip", "standard", "see ```py # stays``` here\n```py\n# open", "see ```py # stays``` here\n```py\n# open"),
    ("comment_strip", "lite", "```ini\n; gone\na = 1 ; stays\n  ```\n# stays\n```\n# no language\n```", "```ini\na = 1 ; stays\n  ```\n# stays\n```\n# no language\n```"),
    ("caveman", "aggressive", "the function(my_var), (function) of the parameters.", " function(my_var), (fn) of params."),
    ("path_collapse", "aggressive", f"{LONG}\n{LONG}\n{LONG}", f"Path aliases: <P1>={LONG}\n{LONG}\n<P1>\n<P1>"),
]


@pytest.mark.parametrize("name,level,text,want", CASES)
def test_engine(name, level, text, want):
    assert rewrite_text(name, text, level)[0] == want
    assert rewrite_text(name, text, "off") == (text, "")


@pytest.mark.parametrize("level", ["lite", "standard", "aggressive"])
def test_traces_shortened_before_stay(level):
    deep = "\n".join(["Traceback"] + [x for i in range(40) for x in (f'  File "m{i}.py", line {i}, in f{i % 7}', "    go()")] + ["Error"])
    for text in (TRACE, deep, deep + "\n" + TRACE):
        once = rewrite_text("stack_trace", text, level)[0]
        assert rewrite_text("stack_trace", once, level)[0] == once


def test_unknown_level():
    with pytest.raises(ValueError):
        rewrite_text("rtk", "x", "ultra")
    with pytest.raises(KeyError):
        rewrite_text("nothing", "x", "lite")


def test_column(spark):
    rows = spark.createDataFrame([(SAME,), (None,), ("",)], "text string").select(rewritten(F.col("text"), "log_collapse", "lite").alias("r"), skip_reason(F.col("text"), False).alias("why")).collect()
    assert rows[0].r.changed and rows[0].r.note == "collapsed 10 lines" and rows[0].why == "no_model"
    assert rows[1].r.text is None and rows[2].r.text == "" and rows[2].why == "too_short"
