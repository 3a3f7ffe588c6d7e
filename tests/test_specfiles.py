import json
import os

from pipework.sources.specfiles import parse_specs, read_spec_files


def test_yaml_and_json_specs(spark, scratch):
    d = os.path.join(scratch, "flows")
    os.makedirs(d)
    with open(os.path.join(d, "a.yaml"), "w") as f:
        f.write("name: a\nqueues:\n  - name: q1\n    capacity: 256\nstages:\n  - name: s\n    type: noop_source\n"
                "    threads: 1\n    output_queue: q1\n    config:\n      message: DEADBEEF\n      max_messages: 20\n")
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump({"name": "b", "stages": [], "bogus": 1}, f)
    rows = {r.spec.name: r for r in read_spec_files(spark, d).collect()}
    assert rows["a"].error is None and rows["a"].spec.queues[0].capacity == 256
    assert '"max_messages"' in rows["a"].spec.stages[0].config
    assert rows["b"].error == 'unknown field "bogus"'


def test_specs_are_loaded_strictly(spark):
    """Unknown fields at every level, also beside nulls; no object, repeated keys, loose JSON and wrong types are errors."""
    cases = [('{"name":"a","stages":[{"name":"s","threads":1}],"queues":[{"name":"q","schema":{"schema_id":"z"}},{"schema":null}]}', None),
             ('{"name":"a","extra":1}', 'unknown field "extra"'), ('{"execution":{"mode":"job","m":2}}', 'unknown field "m"'),
             ('{"stages":[{"nam":1},null]}', 'unknown field "nam"'), ('{"queues":[{"schema":{"format":"json","k":1},"z":2}]}', 'unknown field "k", "z"'),
             ('{"name":"a","version":"x"}', "invalid value"), ('{"stages":{"a":1}}', "invalid value"), ('{"stages":[1]}', "invalid value"),
             ("not json", "invalid JSON"), ("[1]", "invalid JSON"), ("", "invalid JSON"), (None, "invalid JSON"),
             ('{"name":"a","name":"b"}', "invalid JSON"), ("{'name':'a'}", "invalid JSON"), ("{}", None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, json string")
    got = {r.i: r.error for r in parse_specs(df).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}
