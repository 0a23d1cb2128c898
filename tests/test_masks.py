"""Hand-worked cases of masks, phrases and edit projection."""

import pytest
from pyspark.sql import functions as F

from loopsight.functions import text as tx
from loopsight.operators import fingerprint, gate

MASKS = {
    tx.mask_timestamps: [("a 2024-05-01T10:00:00.5+09:00 b", "a <TIMESTAMP> b"), ("2024-05-01T10:00:00Z,2024-05-02", "<TIMESTAMP>,<TIMESTAMP>"), ("1700000000 1700000000123 170000000", "<TIMESTAMP> <TIMESTAMP> 170000000"), ("12024-05-01", "12024-05-01")],
    tx.mask_ports: [
        ("-p 80 -p 90", "-p <PORT> -p <PORT>"), ("-p=80 -p=70000 -p 0", "-p <PORT> -p 70000 -p 0"), ("x-p 80", "x-p 80"), ("--port=8080 --port 99999 --port 1", "--port <PORT> --port 99999 --port <PORT>"), ("--port 80--port 90", "--port <PORT>--port <PORT>"),
        ("host:80 h:65535 h:65536 h:0 a:00080", "host:<PORT> h:<PORT> h:65536 h:0 a:<PORT>"), ("-p 00080x", "-p <PORT>x"), ("(-p 1)(-p 2)", "(-p <PORT>)(-p <PORT>)"),
    ],
    tx.mask_tmp_paths: [("/tmp/a /var/tmp/b /var/folders/x/y z", "<TMP_PATH> <TMP_PATH> <TMP_PATH> z"), (r"C:\Users\me\AppData\Local\Temp\x y", "<TMP_PATH> y"), ("/tmpx", "/tmpx")],
    tx.mask_hashes: [("d41d8cd98f00b204e9800998ecf8427e!", "<HASH>!"), ("123e4567-E89B-12d3-a456-426614174000", "<HASH>"), ("a" * 40 + " " + "b" * 64 + " " + "c" * 41, "<HASH> <HASH> " + "c" * 41)],
    tx.mask_volatile: [("sleep  5; curl h:4000 /tmp/z 12345678901", "sleep <N>; curl h:<PORT> <TMP> <N>"), ("f" * 33 + " h:999", "<HASH> h:999")],
}


@pytest.mark.parametrize("mask", list(MASKS), ids=lambda f: f.__name__)
def test_masks(spark, mask):
    rows = spark.createDataFrame(MASKS[mask], "t string, want string").select(mask(F.col("t")).alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


# (text, kinds, self-referential); each rule of the three lists has a text that only it matches.
SAID = [
    ("수정 완료했습니다", "U", False), ("설치가 완료되었습니다", "U", False), ("성공적으로 처리", "U", False), ("배포 작업이 완료", "U", False), ("정상적으로 완료", "U", False), ("모두 완료", "U", False), ("다 마쳤습니다", "U", False), ("끝냈 습니다", "U", False),
    ("Successfully  executed the plan", "U", False), ("TASK IS FINISHED", "U", False), ("task finished", "U", False), ("제가 검토한 결과 이상없음", "S", True), ("저는 검사해 결과 정상", "S", True), ("확인한 결과 정상적으로 작동", "S", True), ("직접 확인했으니 문제 없습니다", "S", True),
    ("검증 결과 이상 없음", "S", True), ("제가 테스트한 결과 통과", "S", True), ("I verified and it works", "S", True), ("i checked is ok", "S", True), ("as I tested", "S", True),
    ("이전 응답에서", "", True), ("앞서 언급한 바와 같이", "", True), ("제가 작성한 코드이므로", "", True), ("내가 만든 결과라서", "", False), ("내가 만든 코드이니", "", True), ("as I wrote earlier", "", True), ("in my last message", "", True), ("제가 확인했으므로", "", True),
    ("", "", False), (None, "", False), ("the task was handed over successfully", "", False), ("완성도 높은 확인서", "", False), ("task\nis done", "U", False), ("i verified nothing", "", False), ("in my old message", "", False),
]


def test_phrases(spark):
    names = {"UNSUBSTANTIATED_COMPLETION": "U", "SELF_REFERENTIAL_VERIFICATION": "S"}
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(SAID)], "k int, t string").select("k", tx.pattern_kinds(F.col("t")).alias("kinds"), tx.false_success(F.col("t")).alias("any"), tx.self_referential(F.col("t")).alias("own")).orderBy("k").collect()
    assert [("".join(names[x] for x in r["kinds"]), r["own"]) for r in rows] == [(k, own) for _, k, own in SAID]
    assert all(r["any"] == bool(r["kinds"]) for r in rows)


def _calls(spark, calls):
    import json

    rows = [("s", "root", f"u{k}", k, "tool_use", tool, json.dumps(given), None) for k, (tool, given) in enumerate(calls)]
    events = spark.createDataFrame(rows, "session_id string, agent_scope string, uuid string, ts long, kind string, tool string, input_json string, result_class string")
    return fingerprint.to_actions(gate.number_actions(events))


def test_only_edits_of_a_named_file_count(spark):
    edit = lambda k, path: ("Edit", {"file_path": path, "old_string": f"def area of shape number {k}", "new_string": "def area of shape"})
    assert {r["subtype"] for r in gate.hits(_calls(spark, [edit(k, "/a.py") for k in range(6)])).collect()} == {"file_edit_loop"}
    assert gate.hits(_calls(spark, [edit(k, "") for k in range(6)])).count() == 0
    assert gate.hits(_calls(spark, [("Write", {"file_path": "/a.py", "content": f"text {k}"}) for k in range(6)])).count() == 0
    paths = [r["file_path"] for r in _calls(spark, [edit(0, "/a.py"), edit(1, ""), ("Write", {"file_path": "/a.py", "content": "x"}), ("MultiEdit", {"file_path": "/b"}), ("Bash", {"command": "ls"})]).orderBy("seq").collect()]
    assert paths == ["/a.py", None, None, "/b", None]


def test_where_phrases_begin_changes_no_match(spark):
    """As the bare alternatives, for letters that only equal another by case folding too."""
    said = [*(t for t, _, _ in SAID), "ı verified and it works", "İ verified and it works", "ſuccessfully completed", "taſk is done", "TASK IS DONE", "nothing here", "xtask done", "aS I checked", "마쳤 습니다", "저 는 확인 결과 정상", None, ""]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    for patterns, words in ((tx.COMPLETION, tx.COMPLETION_WORDS), (tx.SELF_VERIFICATION, tx.VERIFICATION_WORDS), ([*tx.SELF_VERIFICATION, *tx.SELF_REFERENCE], [*tx.VERIFICATION_WORDS, *tx.REFERENCE_WORDS])):
        plain = F.col("t").rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))
        bare = F.lit(False)
        for w in words:
            bare = bare | F.upper("t").contains(w)
        assert rows.select(tx.says(F.col("t"), patterns, words).alias("a"), (bare & plain).alias("b")).filter("not (a <=> b)").count() == 0
    assert rows.filter(tx.false_success(F.col("t")) != (F.size(tx.pattern_kinds(F.col("t"))) > 0)).count() == 0
