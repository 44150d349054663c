from echofold.__main__ import run


def test_files_round_trip(spark, tmp_path, capsys):
    data = b"a repeated line of some length\n" * 40 + bytes(range(256))
    source, packed, back = (tmp_path / x for x in ("in", "packed", "back"))
    source.write_bytes(data)
    args = ["compress", str(source), str(packed), "--method", "reread", "--min-match", "32", "--seed-size", "16", "--layout", "io", "--block-size", "1KiB"]
    assert run(args, spark) == 0 and packed.stat().st_size < len(data)
    assert run(args, spark) == 18 and run([*args, "--force"], spark) == 0
    assert run(["test", str(packed)], spark) == 0 and run(["info", str(packed)], spark) == 0
    assert "layout: io" in capsys.readouterr().out
    assert run(["decompress", str(packed), str(back), "--output-limit", "10"], spark) == 12 and not back.exists()
    assert run(["decompress", str(packed), str(back)], spark) == 0 and back.read_bytes() == data
    packed.write_bytes(packed.read_bytes()[:-1])
    assert run(["test", str(packed)], spark) == 8 and run(["test", str(tmp_path / "none")], spark) == 17
    assert run(["compress", str(source), str(packed), "--method", "m0", "--seed-size", "4"], spark) == 2


def test_names_and_versions(spark, tmp_path, capsys):
    from echofold import __version__

    source = tmp_path / "data"
    source.write_bytes(b"again and again and again " * 50)
    assert run(["compress", str(source)], spark) == 0 and (tmp_path / "data.echo").exists()
    assert run(["compress", str(source), str(source), "--force"], spark) == 18 and run(["decompress", str(source)], spark) == 2
    assert run(["compress", str(source), str(tmp_path), "--force"], spark) == 18 and run(["compress", str(source), "-", "--force"], spark) == 2
    source.unlink()
    assert run(["decompress", str(tmp_path / "data.echo")], spark) == 0 and source.read_bytes() == b"again and again and again " * 50
    for flag in ("--version", "-V"):
        try:
            run([flag])
        except SystemExit as e:
            assert e.code == 0
        assert capsys.readouterr().out == f"echofold {__version__}\n"


def test_pipes(spark, tmp_path, monkeypatch):
    import io
    import sys
    from types import SimpleNamespace

    data = b"through pipes, through pipes, through pipes " * 30
    pipe = lambda given: (monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(given))), monkeypatch.setattr(sys, "stdout", SimpleNamespace(buffer=(out := io.BytesIO()))), out)[2]
    packed = pipe(data)
    assert run(["compress", "-", "-", "--min-match", "32", "--seed-size", "16"], spark) == 0
    packed = packed.getvalue()
    back = pipe(packed)
    assert 0 < len(packed) < len(data) and run(["decompress", "-", "-"], spark) == 0
    back = back.getvalue()
    pipe(data)
    named = run(["compress", "-"], spark)
    monkeypatch.undo()
    assert back == data and named == 2
