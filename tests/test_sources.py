"""Trees of hand-written files: encodings, headers, broken lines."""
from fairline.sources import files


def _write(root, name, data):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data)


def test_encoding_and_header_are_found_for_each_file(spark, tmp_path):
    _write(tmp_path, "a.csv", "Home,Away\nM\u00e1laga,Lyon\n".encode())
    _write(tmp_path, "b.csv", "Away, Home ,Home\r\nNimes,M\u00e1laga,other\r\n".encode("latin-1"))
    _write(tmp_path, "c.csv", "\ufeff\"Home\",Guest\n\"X, Y\",Z\nshort\na,b,c\na,b,\n\nHome,Guest\n".encode())
    _write(tmp_path, "empty.csv", b"")
    _write(tmp_path, "bare.csv", b"Home,Away\n")
    _write(tmp_path, "other.csv", b"q\n1\n")
    got = files.read_csv_tree(spark, [str(tmp_path)], {"Guest": "Away"}, ["Home", "Away", "Missing"])
    rows = sorted(((r.source_path.rsplit("/", 1)[1], r.Home, r.Away, r.Missing) for r in got.collect()), key=str)
    assert rows == [("a.csv", "M\u00e1laga", "Lyon", None), ("b.csv", "M\u00e1laga", "Nimes", None), ("c.csv", "Home", "Guest", None), ("c.csv", "X, Y", "Z", None), ("c.csv", "a", "b", None),
                    ("c.csv", "short", None, None), ("other.csv", None, None, None)]


def test_headers_beyond_the_broadcast_give_the_same(spark, tmp_path, monkeypatch):
    _write(tmp_path, "a.csv", "Home,Away\nM\u00e1laga,Lyon\n".encode("latin-1"))
    monkeypatch.setattr(files, "HEADS_BYTES", 0)
    assert [tuple(r)[:2] for r in files.read_csv_tree(spark, [str(tmp_path)], {}, ["Home", "Away"]).collect()] == [("M\u00e1laga", "Lyon")]


def test_a_tree_without_lines_is_empty(spark, tmp_path):
    _write(tmp_path, "empty.csv", b"")
    assert files.read_csv_tree(spark, [str(tmp_path)], {}, ["Home"]).collect() == []


def test_tennis_prices_and_order(spark, tmp_path):
    _write(tmp_path, "2025.csv", b"Tournament,Date,Series,Winner,Loser,Comment,PSW,PSL,BFEW,BFEL\nA,2025-01-02,ATP,Zed, Abe ,Completed,1.004,3.0,1.5,2.9\nA,2025-01-03,ATP,Bob,Cid,Retired,2,2,2,2\n")
    _write(tmp_path, "2009.csv", b"Tournament,Date,Tier,Winner,Loser,Comment,PSW,PSL\nB,03/01/2009,T1,Ann,Eve,completed,1.8,2.1\nB,,T1,Ann,Eve,completed,1.8,2.1\n")
    rows = sorted(tuple(r) for r in files.load_tennis(spark, [str(tmp_path)]).select("home", "away", "home_win", "series", "odds_home", "odds_away", "sharp_away", "tour").collect())
    assert rows == [("Abe", "Zed", False, "ATP", 3.0, None, 1.5, "ATP"), ("Ann", "Eve", True, "T1", 1.8, 2.1, 2.1, "ATP")]


def test_a_line_is_parsed_once_whatever_is_filtered(spark, tmp_path):
    _write(tmp_path, "a.csv", b"Home,Away\nLyon,Nice\n,Nice\nLyon,Metz\n")
    got = files.read_csv_tree(spark, [str(tmp_path)], {}, ["Home", "Away"]).where("Home is not null and Away <> 'Metz'").selectExpr("Home", "upper(Away) as a", "Away")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert [tuple(r) for r in got.collect()] == [("Lyon", "NICE", "Nice")]
