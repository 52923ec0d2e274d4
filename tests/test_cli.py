import json

from sparktab.__main__ import main


def test_commands(spark, tmp_path, capsys):
    body = "a long sentence to be stored, " * 20
    payload, held, out = tmp_path / "p.json", str(tmp_path / "store"), tmp_path / "bundle.json"
    payload.write_text(json.dumps([{"i": i, "b": f"{body}{i}"} for i in range(12)]))
    assert main(["compress", "--store", held, str(payload)]) == 0
    text = capsys.readouterr().out
    document = tmp_path / "d.txt"
    document.write_text(text)
    name = json.loads(next(x for x in text.split("\n") if x.startswith("#store"))[6:])
    assert main(["decompress", "--store", held, str(document)]) == 0
    assert json.loads(capsys.readouterr().out) == json.loads(payload.read_text())
    assert main(["decompress", str(document)]) == 2
    assert main(["fsck", held]) == 0 and "BROKEN: 0" in capsys.readouterr().out
    assert main(["fsck", held, "--documents", str(document)]) == 0 and "ORPHANED: 0" in capsys.readouterr().out
    fewer = tmp_path / "fewer.txt"
    fewer.write_text(text.replace("\\@0003", "\\@0002"))
    assert main(["fsck", held, "--documents", str(fewer)]) == 0 and "ORPHANED: 1" in capsys.readouterr().out
    assert main(["list", held]) == 0 and capsys.readouterr().out == name + "\n"
    assert main(["list", "--objects", held]) == 0 and len(set(capsys.readouterr().out.split())) == 12
    assert main(["gc", held]) == 0 and capsys.readouterr().out.startswith("0 ")
    assert main(["export", "--store", held, name, str(out)]) == 0
    assert main(["import", "--store", str(tmp_path / "other"), str(out)]) == 0
    capsys.readouterr()
    assert main(["fetch", "--store", str(tmp_path / "other"), name, "3", "99"]) == 0
    shown = capsys.readouterr().out
    assert f"{body}2" in shown and "unknown_id" in shown
    out.write_text(json.dumps({**json.loads(out.read_text()), "objects": {}}))
    assert main(["import", "--store", str(tmp_path / "third"), str(out)]) == 1


def test_inputs_that_are_no_table(spark, tmp_path, capsysbinary):
    empty, text = tmp_path / "e", tmp_path / "t"
    empty.write_bytes(b"")
    text.write_bytes(b"\xff plain")
    assert main(["compress", str(empty)]) == 2
    assert main(["compress", "-q", str(text)]) == 0 and capsysbinary.readouterr().out == b"\xff plain"


def test_default_root(monkeypatch):
    from sparktab.__main__ import default_root

    monkeypatch.setenv("SPARKTAB_STORE", "/x/y")
    assert default_root() == "/x/y"
    monkeypatch.delenv("SPARKTAB_STORE")
    assert default_root().endswith(".sparktab")
