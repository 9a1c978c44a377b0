from tessera.__main__ import PROGRAMS, main
from tessera.sources.readers import read_lines

EDGES = "1 2\n2 3\n1 3\n3 4\n1 4\n4 5\n3 5\n"
RECTANGLES = "P,p1,10,10,30,45\nQ,q1,20,40,25,45\nR,r1,20,40,60,60\nS,s1,55,55,70,70\n"


def test_programs(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    def run(program, *arguments):
        out = f"file://{tmp_path}/{program}-out"
        assert main([program, *[out if a == "OUT" else f"{out}-temp" if a == "TEMP" else a for a in arguments]]) == 0
        return sorted(r["value"] for r in read_lines(spark, out, *([f"{out}/*"] if program == "controlled" else [])).collect())

    edges, rects, grid = file("edges", EDGES), file("rects", RECTANGLES), ("2", "2", "100", "100")
    assert run("wordcount", file("text", "hello world\nhello\n"), "OUT") == ["hello\t2", "world\t1"]
    assert run("diamonds", edges, "OUT") == ["Total Diamonds Found:\t2"]
    assert run("diamondsp", edges, "OUT", "5") == ["Total Diamonds Found (Weighted Sum):\t2"]
    assert run("replicate", rects, "OUT", *grid) == ["<p1 | q1 | r1 | s1>"]
    main(["-D", "grid.rows=2", "-D", "grid.cols=2", "-D", "grid.width=100", "-D", "grid.height=100", "controlled", rects, f"file://{tmp_path}/controlled"])
    assert [r["value"] for r in read_lines(spark, f"file://{tmp_path}/controlled/*").collect()] == ["<p1 | q1 | r1 | s1>"]
    customers, orders = file("c", "101,Ann,Oslo\n301,Cy,Nice\n255,Bo,Rome\n"), file("o", "901,101,pen\n904,301,hat\n905,7,mug\n")
    assert run("rangejoin", customers, orders, file("p", "200\n300\n"), "OUT") == ["101\tAnn,Oslo,901,pen", "301\tCy,Nice,904,hat"]
    joined = run("gradejoin", file("r", "1,x,x,s,m\n"), file("g", "x,x,x,x,1,A\n"), file("s", "x,x,x,2020,1,x,x,x,m,x,x,4\n"), "TEMP", "OUT")
    assert joined == ["m,s,A,2020,1,4"]
    assert run("gpa", f"file://{tmp_path}/gradejoin-out", "OUT") == ["s\tsgpa_1:9.00,cgpa:9.00"]


CUSTOMERS = "101,John Doe,New York\n102,Jane Smith,Chicago\n255,Peter Jones,New York\n301,Mary Brown,Austin"
ORDERS = "901,101,Laptop\n902,102,Mouse\n903,101,Keyboard\n904,301,Monitor\n905,404,Webcam"
SAMPLE = "P,p1,10,10,20,20\nQ,q1,15,15,25,25\nR,r1,20,20,30,30\nS,s1,25,25,35,35\nP,p2,10,40,20,45\nQ,q2,15,40,25,45\nR,r2,20,40,60,45\nS,s2,55,40,65,45"


def test_golden_samples(spark, tmp_path):
    """The samples' results, end to end; the second rectangle chain crosses cells."""
    for name, text in (("c", CUSTOMERS), ("o", ORDERS), ("p", "200\n300"), ("r", SAMPLE), ("t", "hello world")):
        (tmp_path / name).write_text(text)
    at = lambda name: f"file://{tmp_path}/{name}"
    lines = lambda path: sorted(r["value"] for r in read_lines(spark, path).collect())
    assert main(["rangejoin", at("c"), at("o"), at("p"), at("joined")]) == 0
    assert lines(at("joined")) == ["101\tJohn Doe,New York,901,Laptop", "101\tJohn Doe,New York,903,Keyboard", "102\tJane Smith,Chicago,902,Mouse", "301\tMary Brown,Austin,904,Monitor"]
    assert main(["wordcount", at("t"), at("words")]) == 0 and lines(at("words")) == ["hello\t1", "world\t1"]
    for program in ("replicate", "controlled"):
        assert main([program, at("r"), at(program), "2", "2", "100", "100"]) == 0
        assert lines(at(program) + ("/*" if program == "controlled" else "")) == ["<p1 | q1 | r1 | s1>", "<p2 | q2 | r2 | s2>"]


def test_skew_programs(spark, capsys):
    assert main(["skew", "100", "10", "5"]) == 0
    said = capsys.readouterr().out
    listed = [line.split(": ")[1].split(" rows")[0] for line in said.splitlines() if " join" in line]
    assert len(listed) == 3 and len(set(listed)) == 1 and "heavy values of B: [1, 3], of C: [10, 12]" in said
    assert main(["skew"]) == 0 and "size of the join by key frequencies: 8000050000210000 rows" in capsys.readouterr().out
    assert main(["vanilla"]) == 0 and "size of the join by key frequencies: 1000001000001100000 rows" in capsys.readouterr().out


def test_usage(capsys):
    assert main([]) == 2 and main(["wordcount", "x"]) == 2 and main(["nothing", "x", "y"]) == 2
    usage = capsys.readouterr().err
    assert all(p in usage for p in PROGRAMS)
