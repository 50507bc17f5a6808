import io
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_sources import DOCX, pdf_file

from veilframe import guard, server, sqlfuncs
from veilframe.functions import python_detect
from veilframe.kinds import Settings
from veilframe.session import Session, Store

ROOT = Path(__file__).resolve().parents[1]
CSV = "firma, ad, tckn, eposta\nAcme Holding,Ali,10000000146,a.b@example.com\n"
SECRETS = ("10000000146", "a.b@example.com", "Gtts@2020")


def session(tmp_path, **options):
    return Session(Store(tmp_path / "map.json"), roots=(str(tmp_path),), **options)


def test_round_trip_and_edit(tmp_path):
    s, f = session(tmp_path), tmp_path / "a.csv"
    f.write_text(CSV, encoding="utf-8")
    seen = s.read_anonymized(str(f))
    assert "TCKN_1" in seen and "2 masked: 1 TCKN, 1 EPOSTA" in seen and not any(x in seen for x in SECRETS)
    masked = seen.partition("\n\n(")[0]
    assert s.write_restored(str(tmp_path / "new/b.csv"), masked).endswith("values put back for 2 placeholders")
    assert (tmp_path / "new/b.csv").read_text(encoding="utf-8") == CSV
    assert "one place changed, values put back for 1 placeholder" in s.edit_restored(str(f), "Ali,TCKN_1", "Ali Veli,TCKN_1")
    assert "Ali Veli,10000000146" in f.read_text(encoding="utf-8")
    for old, why in (("nowhere TCKN_1", "does not hold"), (",", "times"), ("", "empty")):
        with pytest.raises(guard.Refused, match=why) as e:
            s.edit_restored(str(f), old, "x")
        assert not any(x in str(e.value) for x in SECRETS)
    again = Session(Store(tmp_path / "map.json"))
    assert again.anonymize_text("c@d.com a.b@example.com") == "EPOSTA_2 EPOSTA_1\n\n(2 masked: 2 EPOSTA)"
    assert again.anonymize_text("plain") == "plain" and len(again.store) == 3
    assert os.stat(tmp_path / "map.json").st_mode & 0o777 == 0o600


def test_documents(tmp_path):
    s = session(tmp_path)
    (tmp_path / "d.docx").write_bytes(DOCX)
    assert "Kurulum Notu" in s.read_anonymized(str(tmp_path / "d.docx"))
    assert "1 place changed" in s.edit_restored(str(tmp_path / "d.docx"), "Kurulum", "Setup")
    before = (tmp_path / "d.docx").read_bytes()
    with pytest.raises(guard.Refused, match="nodes"):
        s.edit_restored(str(tmp_path / "d.docx"), "absent", "x")
    assert (tmp_path / "d.docx").read_bytes() == before
    (tmp_path / "p.pdf").write_bytes(pdf_file("Musteri kaydi tckn 10000000146 eposta a.b@example.com"))
    assert "TCKN_1" in s.read_anonymized(str(tmp_path / "p.pdf"))
    (tmp_path / "scan.pdf").write_bytes(pdf_file("1"))
    assert "WARNING" in s.read_anonymized(str(tmp_path / "scan.pdf"))
    for name, whole in (("d.docx", "Office"), ("p.pdf", "PDF"), ("i.png", "picture")):
        with pytest.raises(guard.Refused, match=whole):
            s.write_restored(str(tmp_path / name), "x")


def test_guards(tmp_path):
    s = session(tmp_path)
    s.anonymize_text("10000000146")
    outside = tmp_path.parent / "outside"
    outside.mkdir(exist_ok=True)
    (tmp_path / "link").symlink_to(outside)
    for path in ("/dev/stdout", "/dev/fd/1", "/proc/self/fd/1", "/etc/hosts", f"{tmp_path}/../../etc/hosts", f"{tmp_path}/../x/new.txt", f"{tmp_path}/link/new.txt"):
        with pytest.raises(guard.Refused) as e:
            s.write_restored(path, "TCKN_1")
        assert "10000000146" not in str(e.value)
    assert not (outside / "new.txt").exists()
    with pytest.raises(guard.Refused, match="switched off"):
        s.restore_text("TCKN_1")
    open_ = Session(s.store, allow_reveal=True)
    assert open_.restore_text("TCKN_1") == "10000000146" and open_.restore_text("TCKN_9").startswith("(none of")
    assert [len(x.tools()) for x in (s, open_)] == [4, 5]
    assert s.has_restorable_placeholder("a TCKN_1") and not s.has_restorable_placeholder("TCKN_2")
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ValueError, match="no mapping file"):
        Store(tmp_path / "bad.json")


def test_protocol(tmp_path):
    s, f = session(tmp_path), tmp_path / "a.csv"
    f.write_text(CSV, encoding="utf-8")
    call = lambda n, **a: {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": n, "arguments": a}}
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, call("read_anonymized", path=str(f)), call("read_anonymized"), call("nope"), call("read_anonymized", path=str(tmp_path / "gone")), {"jsonrpc": "2.0", "id": 4, "method": "x"}, {"jsonrpc": "2.0", "id": 5, "method": "ping"}]
    out = io.StringIO()
    server.serve(s, io.StringIO("\n".join(map(json.dumps, lines)) + "\n\n{bad\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert got[0]["result"]["serverInfo"]["name"] == "veilframe" and len(got[1]["result"]["tools"]) == 4
    assert "TCKN_1" in got[2]["result"]["content"][0]["text"] and "isError" not in got[2]["result"]
    assert all(g["result"]["isError"] for g in got[3:6]) and "is needed" in got[3]["result"]["content"][0]["text"]
    assert got[6]["error"]["code"] == -32601 and got[7]["result"] == {} and got[8]["error"]["code"] == -32700 and len(got) == 9


def test_command_line():
    run = lambda *a: subprocess.run([sys.executable, "-m", "veilframe", *a], cwd=ROOT, capture_output=True, text=True, stdin=subprocess.DEVNULL)
    assert run("--version").stdout.startswith("veilframe ") and "VEILFRAME_ROOTS" in run("--help").stdout
    assert run("--version", "--bogus").returncode == 2 and run().returncode == 0


def test_sql_functions(spark):
    assert len(sqlfuncs.register(spark)) == len(sqlfuncs.FUNCTIONS)
    values = ["10000000146", "12345678901", "4111 1111 1111 1111", "4111 1111 1111 1112", "", "TCKN_1", "TCKN_1\n", "X_1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.selectExpr("v", "vf_luhn_valid(v) l", "vf_tckn_valid(v) t", "vf_is_placeholder(v) p", "vf_digit_count(v) n").collect():
        assert (r["l"], r["t"], r["p"]) == (python_detect.luhn_valid(r["v"]), python_detect.tckn_valid(r["v"]), python_detect.is_placeholder(r["v"])), r["v"]
    one = spark.sql("SELECT vf_restore('a TCKN_1, TCKN_2.', map('TCKN_1', 'x')) r, vf_edit_once('abc', 'b', 'z') e, vf_edit_once('bb', 'b', 'z') f, vf_digit_isolated('a1', 0, 1) i, vf_placeholders('TCKN_1 xTCKN_2') p").first()
    assert tuple(one) == ("a x, TCKN_2.", "azc", "bb", False, ["TCKN_1"])


def test_stream_equals_batches(spark, tmp_path):
    from veilframe.streaming.mask_stream import known_before, mask_stream

    rows = [(1, "a@b.com x"), (2, "c@d.com a@b.com"), (3, "e@f.org c@d.com"), (4, "10000000146")]
    src, args = tmp_path / "in", (str(tmp_path / "map"), str(tmp_path / "out"), str(tmp_path / "cp"))
    for i in (0, 2):
        spark.createDataFrame(rows[i:i + 2], "id bigint, text string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("id bigint, text string").parquet(str(src))
        mask_stream(stream, "text", "id", "id", *args).awaitTermination(120)
    got = {r["id"]: r["masked"] for r in spark.read.parquet(args[1]).select("id", "masked").collect()}
    assert got == {1: "EPOSTA_1 x", 2: "EPOSTA_2 EPOSTA_1", 3: "EPOSTA_3 EPOSTA_2", 4: "TCKN_1"}
    assert known_before(spark, args[0], 99).count() == 4 and known_before(spark, args[0], 0).count() == 0
    assert spark.read.parquet(args[1]).filter(F.col("summary") == "2 EPOSTA").count() == 2


def test_settings_reject_unknown_kinds():
    with pytest.raises(ValueError, match="unknown kinds"):
        Settings(("email", "nope"))


def test_default_mapping_file(tmp_path):
    for env, want in (({"HOME": str(tmp_path)}, tmp_path / ".veilframe" / "mappings.json"), ({"HOME": str(tmp_path), "VEILFRAME_MAPPINGS": str(tmp_path / "own.json")}, tmp_path / "own.json")):
        s = Session.from_env(env)
        assert s.store.path == want and not want.exists()
        assert s.anonymize_text("a@b.com").startswith("EPOSTA_1") and len(s.store) == 1 and want.exists()
        assert len(Session.from_env(env).store) == 1
    assert Session.from_env({}).store.path is None
