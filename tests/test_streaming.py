import json

from paperlane.config import CaptureConfig, FieldSpec, Profile
from paperlane.streaming.intake import arrivals, documents, write_json

JOB = Profile("job", ("job",), (), (FieldSpec("n", ("Number",), "integer"),))


def test_files_are_analysed_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("Job\nNumber: 5\n")
    (inbox / "b.txt").write_text("Job\nNumber: 5\n")
    (inbox / "c.md").write_text("Job\nNumber: 6\n")

    def drain():
        q = write_json(documents(arrivals(spark, str(inbox)), [JOB], CaptureConfig()), str(tmp_path / "out"), str(tmp_path / "state"))
        q.processAllAvailable()
        q.stop()
        return sorted(json.loads(r.value)["fields"]["n"]["value"] for r in spark.read.text(str(tmp_path / "out")).collect())

    assert drain() == [5]
    (inbox / "d.txt").write_text("Job\nNumber: 7\n")
    assert drain() == [5, 7]
