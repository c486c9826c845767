import pytest

from causalspark.sources import tabular

TEXT = """// a comment
/variables
X: Continuous
"Y": 0=low, 1=mid, 2=high
Z: no, yes

/data
X\tY\tZ\tW\t
1\tlow\tyes\t3
2.5\thigh\t*\t1
// another
*\tmid\tno\t3
/knowledge
addtemporal
1 X Y
2 Z W
forbiddirect
X W
"""


def written(tmp_path, text, name="t.txt"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_sections(spark, tmp_path):
    df, values, known = tabular.read_sections(spark, written(tmp_path, TEXT), max_discrete=2)
    assert dict(df.dtypes) == {"X": "double", "Y": "string", "Z": "string", "W": "string"}
    assert sorted((tuple(r) for r in df.collect()), key=str) == [(1.0, "low", "yes", "3"), (2.5, "high", None, "1"), (None, "mid", "no", "3")]
    assert values == {"Y": ["low", "mid", "high"], "Z": ["no", "yes"]}
    assert known.tiers == [["X", "Y"], ["Z", "W"]] and known.forbidden("X", "W") and known.forbidden("Z", "X") and not known.forbidden("X", "Z")


def test_data_section_alone_and_faults(spark, tmp_path):
    df, values, known = tabular.read_sections(spark, written(tmp_path, "/data\na b\n1 2\n3 4\n"), "whitespace")
    assert df.count() == 2 and df.columns == ["a", "b"] and not values and not known.tiers
    with pytest.raises(ValueError):
        tabular.read_sections(spark, written(tmp_path, "/variables\na: x, y\n", "u.txt"))
    bad, _, _ = tabular.read_sections(spark, written(tmp_path, "/variables\na: x, y\n/data\na\nx\nz\n", "v.txt"))
    with pytest.raises(Exception, match="does not have the value z"):
        bad.collect()


def test_case_ids(spark, tmp_path):
    first = tabular.read_table(spark, written(tmp_path, "a,b\nr1,1,2\nr2,3,4\n"), "comma", ids=True)
    assert first.columns == ["id", "a", "b"] and {tuple(r) for r in first.collect()} == {("r1", 1.0, 2.0), ("r2", 3.0, 4.0)}
    named = tabular.read_table(spark, written(tmp_path, "a,case\n1,7\n3,8\n"), "comma", ids="case")
    assert dict(named.dtypes) == {"a": "double", "case": "string"}
    bare = tabular.read_table(spark, written(tmp_path, "7:1:2\n8:3:4\n"), "colon", header=False, ids=True)
    assert bare.columns == ["id", "X1", "X2"]
    with pytest.raises(ValueError):
        tabular.read_table(spark, written(tmp_path, "a\n1\n"), ids="case")
