"""The command line: builds a network from lines, then asks it."""

import pytest

from lodestone import __main__ as cli


def test_options():
    p = cli.parser()
    q = p.parse_args(["query", "-d", "net", "-o", "out", "heart", "skin"])
    assert (q.num_topics, q.cloud_size, q.num_papers_per_topic, q.words) == (20, 5000, 10, ["heart", "skin"])
    b = p.parse_args(["build", "a.xml", "-o", "net"])
    assert (b.vector_dim, b.num_nearest_neighbors, b.min_count, b.min_doc_length) == (500, 100, 5, 20)
    for bad in (["query", "-d", "n", "-o", "o", "-n", "0", "a", "b"], ["build", "x", "-o", "n", "--rare-fraction", "2"], ["build", "x", "-o", "n", "--keywords", "some"], ["query", "-d", "n", "-o", "o", "one"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_build_and_query(spark, tmp_path):
    words = [["heart", "attack", "risk", "aspirin"], ["skin", "rash", "cream", "burn"], ["aspirin", "burn", "pain", "dose"]]
    lines = [f"PMID{k}_1 {1990 + k} " + " ".join(words[k % 3][(k + j * j) % 4] for j in range(12)) + f" w{k % 7}" for k in range(30)]
    (tmp_path / "docs").write_text("\n".join(lines) + "\n")
    (tmp_path / "extra").write_text("heart skin 0.5\n")
    (tmp_path / "plug").write_text('{"text-plugins": [], "edge-plugins": [["%s", 3.0]]}' % (tmp_path / "extra"))
    (tmp_path / "params").write_text("L2 -0.5 1 0 2\nTopicNetMod 0.5 1 0 1\n")
    net, out = str(tmp_path / "net"), str(tmp_path / "out")
    assert cli.main(["--master", "local[2]", "build", str(tmp_path / "docs"), "--lines", "-o", net, "-V", "8", "-N", "3", "-m", "1", "-M", "3", "--filter-year", "2015", "--plugin-config", str(tmp_path / "plug")]) == 0
    assert spark.read.parquet(f"{net}/documents").count() == 26
    assert cli.main(["query", "-d", net, "-o", out, "-n", "3", "--iterations", "3", "--cloud-size", "10", "--num-papers-per-topic", "2", "-y", str(tmp_path / "params"), "--write-topic-network", "Heart", "skin"]) == 0
    assert {r.label for r in spark.read.csv(f"{out}/path", header=True).collect()} >= {"heart", "skin"}
    assert {r[0] for r in spark.read.csv(f"{out}/eval", sep="\t").collect()} == {"L2", "TopicNetMod", "PolyMultiple"}
    assert spark.read.text(f"{out}/papers").count() > 0 and spark.read.csv(f"{out}/topic_network", header=True).count() > 0
    assert cli.main(["query", "-d", net, "-o", out, "--path-only", "heart", "nothing"]) == 1
