"""Scalar functions on written-out cases: each row of a table takes one, and the SQL holds what it gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import dates as D
from tapewright.functions import text as X
from tapewright.functions import values as V
from tapewright.operators import reconcile, resolve
from tapewright.plans import moves
from tapewright.queries.base import by_case
from tapewright.sources import guide


def _joined(array, by: str = ","):
    return F.array_join(array, by)


@by_case("part", "p_partkey", [("ＡＢＣ　１",), ("Straße",), ("ｶﾞﾝﾀﾞﾑ",), (" Plain Title ",), ("ﬁne",), ("İx",), (None,), ("",)], [("abc 1",), ("strasse",), ("ガンダム",), ("plain title",), ("fine",), ("i̇x",), (None,), ("",)], "form")
def case_casefold(c):
    return X.casefold(c)


@by_case("part", "p_partkey", [("a　 b\t c",), ("  x ",), (None,), ("",), ("a\nb",), ("\u3000題　名\u3000",)], [("a b c",), ("x",), ("",), ("",), ("a b",), ("題 名",)], "form")
def case_single_spaces(c):
    return X.single_spaces(c)


@by_case("part", "p_partkey", [("番組「副題」x",), ("「」",), ("「" + "字" * 121 + "」",), ("「" + "字" * 120 + "」",), ("x",), ("「a」「b」",), ("「a",), ("『a』「b",)], [("副題",), (None,), (None,), ("字" * 120,), (None,), ("a",), (None,), (None,)], "subtitle")
def case_quoted_subtitle(c):
    return X.quoted_subtitle(c)


@by_case("part", "p_partkey", [("名作選 題",), ("題_選",), ("-題-",), ("傑作選",), ("選択",), ("題",), ("_ -",)], [("題",), ("題",), ("題",), ("",), ("択",), ("題",), ("",)], "rest")
def case_drop_labels(c):
    return X.drop_labels(c)


@by_case(
    "part", "p_partkey",
    [("【NHK地域局発】_話_",), ("【NHK地域局発】名作選 話",), ("【ハートネットTV】虹クロ_「心の声」▼x",), ("【ハートネットtv】 虹クロ 話題▼続き",), ("アナザーストーリーズ選_その話▼x",), ("アナザーストーリーズ",),
     ("「題」残り「副」",), ("『題』",), ("「題」続き",), ("【特選】名前_x「副」",), ("【再】▼話",), ("【再】a b",), ("番組 名「副」",), ("番組_2024「副」",), ("x" * 90,), (" 番組",), ("【新】",)],
    [("NHK地域局発", "話"), ("NHK地域局発", "話"), ("虹クロ", "心の声"), ("虹クロ", "話題"), ("アナザーストーリーズ", "その話"), ("アナザーストーリーズ", None),
     ("題", "副"), ("題", None), ("題", None), ("名前", "副"), ("再", None), ("再", None), ("番組", "副"), ("番組", "副"), ("x" * 80, None), ("", None), ("新", None)],
    "program, subtitle",
)
def case_program_and_subtitle(c):
    both = X.program_and_subtitle(c)
    return both["program"], both["subtitle"]


@by_case("part", "p_partkey", [("a_12 x",), ("none",), ("x-b_3_4",), ("Show_7.mp4",)], [("a no 12",), (None,), ("b_3 no 4",), ("Show no 7",)], "title")
def case_expand_rule(c):
    return X.expand_rule(c, r"(\w+)_(\d+)", r"\1 no \2")


@by_case(
    "part", "p_partkey", [("x 第 12 話",), ("第3話",), ("x(4) ",), ("x(5)y",), ("第x話",), ("第7話(8)",), ("(9)",), ("x",), ("第　10　話",)],
    [(12,), (3,), (4,), (None,), (None,), (7,), (9,), (None,), (10,)], "episode",
)
def case_episode_number(c):
    return X.episode_number(c)


@by_case(
    "orders", "o_orderkey", [("x 2024 03 04 21 00",), ("x_2024_03_04_21_00_59",), ("x 2024_03 04_21 00.mp4",), ("2024 03 04",), ("x 2024 03 04 21 00 y",), ("2026 03 24 25 10",), ("x2024-03-04-21-00",)],
    [("2024-03-04 21:00",), ("2024-03-04 21:00",), ("2024-03-04 21:00",), (None,), (None,), ("2026-03-24 25:10",), (None,)], "recorded",
)
def case_recording_time(c):
    return D.recording_time(c)


@by_case(
    "orders", "o_orderkey",
    [("t 2024_01_02_21_00.mp4",), ("t 2024 01 02 21 00.mp4",), ("t 2024_01_02_21_00_(1).mp4",), ("t 2024_01_02_21_00(2).mp4",), ("t 20240102210000.mp4",), ("t 202401022100.mp4",), ("t 2024-01-02-2100.mp4",), ("t 2024 01 02 21:05.mp4",),
     ("t 2024_01_02_2100.mp4",), ("t.mp4",), ("2024_01_02_21_00",), ("t 2024_01_02.mp4",)],
    [("2024-01-02", "t")] * 9 + [(None, "t"), (None, "2024_01_02_21_00"), (None, "t 2024_01_02")],
    "air_date, stem",
)
def case_file_air_date(c):
    return D.file_air_date(c), X.strip_date_suffix(c)


@by_case(
    "orders", "o_orderkey", [("2024-05-06",), (" ",), ("24-05-06",), (None,), ("2024-05",), ("2024-13-99",), ("2024-5-6",), ("2024-05-06 ",), ("2024-05-06T00",)],
    [("2024", "05", None, True), (None, None, "missing_air_date", False), (None, None, "invalid_air_date", False), (None, None, "missing_air_date", False), (None, None, "invalid_air_date", False), ("2024", "13", None, True),
     (None, None, "invalid_air_date", False), ("2024", "05", None, False), ("2024", "05", None, False)],
    "year, month, error, iso",
)
def case_year_month(c):
    ym = D.year_month(c)
    return ym["year"], ym["month"], ym["error"], D.is_iso_date(c)


@by_case("events", "event_id", [("2024-01-02T03:04:05+00:00",), ("2024-01-02 03:04:05",), ("2024-01-02T05:04:05+02:00",), ("x",), (None,)], [("20240102_030405",), ("20240102_030405",), ("20240102_030405",), (None,), (None,)], "stamp")
def case_updated_at(c):
    return D.compact_time(D.updated_at(c))


@by_case(
    "documents", "doc_id", [("番組名[字][再] 第1話",), ("[新]番組",), ("番組",), ("a[]b",), (" [再放送] x ",), ("[再",)],
    [("番組名 第1話", "字,再", True), ("番組", "新", False), ("番組", "", False), ("ab", "", False), ("x", "再放送", False), ("[再", "", False)], "title, annotations, again",
)
def case_title_line(c):
    line = guide.title_line(c)
    return line["official_title"], _joined(line["annotations"]), line["is_rebroadcast_flag"]


@by_case("documents", "doc_id", [("アニメ - 国内;その他; ;ジャンル :",), ("a-b - c",), ("",), ("x -y;ジャンル:;z",)], [("アニメ|国内;その他|",), ("a|b - c",), ("",), ("x|y;z|",)], "genres")
def case_genres(c):
    return _joined(F.transform(guide.genres(F.split(c, ";")), lambda g: F.concat_ws("|", g["category"], g["subcategory"])), ";")


@by_case("documents", "doc_id", [("ServiceID:7;x;EventID:12(0x0C)",), ("OriginalNetworkID:32736;TransportStreamID:32736",), ("ServiceID:x",), ("",)], [("EventID=12,ServiceID=7",), ("OriginalNetworkID=32736,TransportStreamID=32736",), ("",), ("",)], "ids")
def case_network_ids(c):
    return _joined(F.array_sort(F.transform(F.map_entries(guide.network_ids(F.split(c, ";"))), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))))


@by_case("documents", "doc_id", [('{"a": 1}',), ("[1]",), ("bad",), (None,), (' {"b": [2]}',), ('"x"',), ("{bad",)], [('{"a": 1}',), ("{}",), ("{}",), ("{}",), (' {"b": [2]}',), ("{}",), ("{}",)], "object")
def case_json_object(c):
    return V.json_object(c)


@by_case(
    "documents", "doc_id", [('{"b": 2, "a": "x", "c": {"z": [1, null], "y": true}}',), ("{}",), ('{"a": null, "B": 1.5}',)],
    [('{"a":"x","b":2,"c":{"y":true,"z":[1,null]}}', '{"b":2,"c":{"y":true,"z":[1,null]},"k":"v"}'), ("{}", '{"k":"v"}'), ('{"B":1.5,"a":null}', '{"B":1.5,"k":"v"}')], "stable, changed",
)
def case_stable_json(c):
    from tapewright.operators.catalog import json_set

    return V.stable_json(V.json_fields(c)), json_set(c, {"k": F.lit("v")}, ["a"])


@by_case("documents", "doc_id", [('log\n{"a":1}\n\n',), ('{"a":1}\n{"b":2}\nend',), ("[1]\nx",), (None,), ('{"a":1}\r\n{bad',)], [('{"a":1}',), ('{"b":2}',), (None,), (None,), ('{"a":1}',)], "last")
def case_last_json_object(c):
    return V.last_json_object(c)


@by_case("documents", "doc_id", [("a,,b, ",), ("",), (" , ",), ("x",)], [("a|b",), ("",), ("",), ("x",)], "parts")
def case_some_text(c):
    return _joined(V.some_text(F.split(c, ",")), "|")


@by_case(
    "pages", "page_id", [("D:\\x\\a.ts",), ("z:\\y",), ("F:\\q",), ("",), (None,), ("d:\\",)],
    [("E:\\x\\a.ts", True), ("C:\\y", False), (None, False), (None, False), (None, None), ("E:\\", False)], "old_path, below",
)
def case_remap_drive(c):
    return reconcile.remap_drive(c, {"d": "E:", "Z:\\": "c", " ": "x"}), reconcile.under_roots(c, ["D:\\X\\", "q:"])


@by_case(
    "pages", "page_id", [("/mnt/b/x/y.mp4",), ("c:/q",), ("b:\\z",), ("/mnt/d",), ("/mnt/dd/x",), ("rel/x",), ("",)],
    [("B:\\x\\y.mp4", "/mnt/b/x/y.mp4"), ("C:\\q", "/mnt/c/q"), ("B:\\z", "/mnt/b/z"), ("D:\\", "/mnt/d/"), ("\\mnt\\dd\\x", "/mnt/dd/x"), ("rel\\x", "rel/x"), ("", "")], "path, mount",
)
def case_paths(c):
    return X.windows_path(c), X.mount_path(X.windows_path(c))


@by_case(
    "pages", "page_id", [("B:\\by_program\\T\\a",), ("B:\\VideoLibrary\\U\\a",), ("B:\\x\\a",), ("B:\\videolibrary",), (None,), ("B:\\VideoLibrary\\By_Program\\V\\a",)],
    [("T",), ("U",), (None,), (None,), (None,), ("V",)], "folder",
)
def case_folder_title(c):
    return X.folder_title(c)


@by_case(
    "part", "p_partkey", [("あさ",), ("ガ",), ("ぱ",), ("ん",), ("漢字",), ("Abc",), ("",), (None,), ("ー",), ("ヴ",), ("しろ",), ("ちち",), ("の",), ("み",), ("ゆ",), ("れ",)],
    [("ア",), ("カ",), ("ハ",), ("ワ",), ("MV",), ("MV",), ("MV",), ("MV",), ("MV",), ("MV",), ("サ",), ("タ",), ("ナ",), ("マ",), ("ヤ",), ("ラ",)], "folder",
)
def case_syllabary(c):
    return X.syllabary(c)


@by_case("part", "p_partkey", [("1920x1080",), ("720",), ("hd",), (None,), ("1440 X 1080i",), ("59.94",), ("",), ("-3",), ("x1080",)], [(2073600,), (720,), (0,), (0,), (1555200,), (59,), (0,), (-3,), (0,)], "score")
def case_resolution(c):
    return V.resolution_score(c)


@by_case("events", "event_id", [("src_not_found: D:\\x",), ("dst_exists",), (" a b :c:d",), ("",), (":x",)], [("src_not_found",), ("dst_exists",), ("a b",), ("",), ("",)], "error_class")
def case_error_class(c):
    return X.error_class(c)


@by_case(
    "part", "p_partkey", [("Great Show X", "D:\\f\\シリーズ_A\\x"), ("other", "D:\\f\\シリーズ_A\\x"), ("other", "D:\\f"), (None, None), ("Show two", "D:\\シリーズ_B")],
    [("F1",), ("シリーズ_A",), (None,), (None,), ("F2",)], "franchise",
)
def case_franchise(title, path):
    return moves.franchise(title, path, [("F1", ["Great", ""]), ("F2", ["two", "Show"])])


@by_case(
    "part", "p_partkey", [("the show one",), ("two and show",), ("none",), ("",)], [("S",), ("S",), (None,), (None,)], "title",
)
def case_first_alias(c):
    return resolve.first_alias(c, [("show", "S"), ("two", "T")])
