from engram.__main__ import main


def test_a_store_from_the_command_line(spark, tmp_path):
    project, store = tmp_path / "mill", str(tmp_path / "store")
    project.mkdir()
    (project / "notes.md").write_text("The kitchen door is green and opens to the garden. " * 4)
    (project / "plan.txt").write_text("The river feeds the wheel, and the wheel turns the stones. " * 4)
    run = lambda *a: main(["--store", store, "--now", "1710000000", *a]).collect()
    assert run("init")[0].memories == 0
    assert run("mine", str(project))[0].memories == 2
    assert run("mine", str(project))[0].memories == 2
    (project / "plan.txt").write_text("Now the wind turns the stones and nothing is left of the former plan. " * 3)
    import os

    os.utime(project / "plan.txt", (1, 1))
    assert run("mine", str(project), "--wing", "mill")[0].memories == 2
    assert "kitchen door" in run("search", "kitchen door", "--k", "1")[0].line
    assert "mill" in str(run("wakeup")) or "ESSENTIAL STORY" in run("wakeup")[0].text
    assert len(run("compress", "--wing", "mill")) == 2
    assert run("prune", "--theta", "0.99")[0].merged == 0
    assert run("status")[0].wings == 1
