"""Scalar functions at their boundaries and against the standard library."""

import hashlib
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from tapewright.functions import dates as D
from tapewright.functions import keys as K
from tapewright.functions import text as X
from tapewright.functions import values as V
from tapewright.operators import resolve


def apply(spark, f, *rows, types="a string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], types)
    return [r[0] for r in df.select(f(*[F.col(c) for c in df.columns])).collect()]


def test_uuid5(spark):
    names = ["", "a", "日本語のパス", "İ", "x" * 500]
    assert apply(spark, lambda a: K.uuid5(K.URLS, a), *names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    path = "D:/Lib/番組.mp4"
    want = str(uuid.uuid5(uuid.UUID(K.PATHS), "winpath:" + path.replace("/", "\\").lower()))
    assert apply(spark, K.path_id, path) == [want]
    assert apply(spark, K.file_id, want) == [str(uuid.uuid5(uuid.UUID(K.FILES), f"path:{want}"))]


def test_nfkc_and_casefold(spark):
    names = ["ＡＢＣ　１", "ｶﾞﾝﾀﾞﾑ", "Straße", "plain Title ", None]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = {r.t: r for r in X.normalized_map(X.normalized_map(df, "t", X.nfkc, "n"), "t", X.casefold, "c").collect()}
    for n in names[:-1]:
        assert got[n].n == unicodedata.normalize("NFKC", n) and got[n].c == unicodedata.normalize("NFKC", n).casefold().strip()
    assert got[None].n is None


def test_program_key(spark):
    assert apply(spark, X.program_key, " My  Show: 2/3? ", "", None, "__", "a　b") == ["my_show_23", "unknown", "unknown", "unknown", "a_b"]
    assert apply(spark, X.display_key, " My  Show ", None) == ["My_Show", "UNKNOWN"]


@pytest.mark.parametrize("extra, swallowed", [(7, False), (8, True)])
def test_swallowed_title_boundary(spark, extra, swallowed):
    assert apply(spark, X.swallowed, ("show", "show" + "x" * extra), types="a string, b string") == [swallowed]


def test_shortened_title_boundary(spark):
    assert apply(spark, X.shortened, ("abcd", "ab"), ("abcde", "ab"), ("ab", "ab"), ("ab", None), types="a string, b string") == [False, True, False, False]


def test_safe_dir(spark):
    long = "題" * 70
    got = apply(spark, X.safe_dir, 'a<b>:"/\\|?*', " x\t\ty. . ", "", None, long)
    assert got[:4] == ["a＿b＿＿＿＿＿＿＿＿", "xy", "UNKNOWN", "UNKNOWN"]
    assert got[4] == long[:51] + "_" + hashlib.sha1(long.encode()).hexdigest()[:8]


def test_paths(spark):
    assert apply(spark, X.windows_path, "/mnt/b/x/y.mp4", "c:/q", "b:\\z") == ["B:\\x\\y.mp4", "C:\\q", "B:\\z"]
    assert apply(spark, X.mount_path, "B:\\x\\y.mp4") == ["/mnt/b/x/y.mp4"]
    assert apply(spark, X.path_parts, "B:\\x\\y.MP4", "B:\\x\\.hid")[0].asDict() == {"drive": "B", "dir": "B:\\x", "name": "y.MP4", "ext": ".mp4"}
    assert apply(spark, X.folder_title, "B:\\by_program\\T\\a", "B:\\VideoLibrary\\U\\a", "B:\\x\\a", "B:\\videolibrary", None) == ["T", "U", None, None, None]


def test_syllabary(spark):
    assert apply(spark, X.syllabary, "あさ", "ガ", "ぱ", "ん", "漢字", "Abc", "", None) == ["ア", "カ", "ハ", "ワ", "MV", "MV", "MV", "MV"]


def test_titles(spark):
    assert apply(spark, X.before_separator, "番組▽副題▼x", "「引用」", "そのまま") == ["番組", "", "そのまま"]
    assert apply(spark, X.episode_number, "x 第 12 話", "x(3) ", "x(3)y") == [12, 3, None]
    assert [tuple(r) for r in apply(spark, X.program_and_subtitle, "【NHK地域局発】_話_", "「題」残り「副」", "【特選】名前_x「副」", "番組 名「副」", "アナザーストーリーズ選_その話▼x")] == [
        ("NHK地域局発", "話"), ("題", "副"), ("名前", "副"), ("番組", "副"), ("アナザーストーリーズ", "その話"),
    ]
    assert apply(spark, lambda a: X.expand_rule(a, r"(\w+)_(\d+)", r"\1 no \2"), "a_12 x", "none") == ["a no 12", None]
    assert apply(spark, X.overlap_score, ("A b", "ab"), ("ab", "xaby"), ("foo bar", "barbaz"), ("", "x"), types="a string, b string") == [10_000, 2, 3, 0]


def test_dates(spark):
    names = ["t 2024_01_02_21_00.mp4", "t 2024 01 02 21 00.mp4", "t 2024_01_02_21_00_(1).mp4", "t 20240102210000.mp4", "t 2024-01-02-2100.mp4", "t.mp4"]
    assert apply(spark, D.file_air_date, *names) == ["2024-01-02"] * 5 + [None]
    assert apply(spark, X.strip_date_suffix, *names) == ["t"] * 6
    assert [tuple(r) for r in apply(spark, D.year_month, "2024-05-06", " ", "24-05-06", None, "2024-05")] == [
        ("2024", "05", None), (None, None, "missing_air_date"), (None, None, "invalid_air_date"), (None, None, "missing_air_date"), (None, None, "invalid_air_date"),
    ]
    assert apply(spark, D.is_iso_date, "2024-13-99", "2024-1-1", None) == [True, False, False]
    assert tuple(apply(spark, D.guide_range, "2024/01/02(火) 25:10～26:00")[0]) == ("2024-01-02", "25:10", "26:00")
    assert apply(spark, D.recording_time, "x 2024 03 04 21 00", "x") == ["2024-03-04 21:00", None]
    a, b = apply(spark, D.updated_at, "2024-01-02T03:04:05+00:00", "2024-01-02 03:04:05")
    assert a == b


def test_values(spark):
    assert apply(spark, V.resolution_score, "1920x1080", "720", "hd", None) == [2073600, 720, 0, 0]
    assert apply(spark, lambda a: V.json_flag(a, "f"), '{"f": true}', '{"f": 0}', '{"f": "yes"}', '{"f": "x"}', "bad") == [True, False, True, None, None]
    assert apply(spark, V.json_object, '{"a": 1}', "[1]", "bad", None) == ['{"a": 1}', "{}", "{}", "{}"]
    assert apply(spark, lambda a: V.all_in(V.some_text(F.split(a, ",")), ["x"]), "x,x", "x,y", "") == [True, False, True]
    assert apply(spark, lambda a: V.flag(a, True), "No", "1", "?") == [False, True, True]


def test_keys(spark):
    key = lambda *a: K.dedup_key(*a)
    t = "a string, b string, c string"
    assert apply(spark, key, ("k", " 7 ", None), ("k", "", " A  b"), ("k", None, ""), ("unknown", "1", None), types=t) == ["k::ep::7", "k::sub::a b", None, None]
    assert apply(spark, K.episode_key, ("k", None, "A  B", "2024"), ("k", None, None, "2024"), types=t + ", d string") == ["k::sub::a  b", "k::date::2024"]


def test_affected_root(spark):
    rows = [("B:\\lib\\Old\\2024\\01\\a.mp4", "Old"), ("B:/lib/Old/a.mp4", "Old"), ("B:\\x\\a.mp4", "Old"), ("", "Old"), (None, "x")]
    assert apply(spark, resolve.affected_root, *rows, types="a string, b string") == ["B:\\lib", "B:\\lib", "B:\\", None, None]


def test_stable_json_evaluates_its_map_once(spark):
    from tapewright.functions import values

    out = values.stable_json(values.json_fields(F.col("x")))
    assert str(out).count("try_parse_json") == 1
    given = [('{"b":1,"a":{"z":[1,null]},"é":"x","B":null}',), ("{}",), (None,), ("[1]",)]
    assert [r[0] for r in spark.createDataFrame(given, "x string").select(out).collect()] == ['{"B":null,"a":{"z":[1,null]},"b":1,"é":"x"}', "{}", None, None]
