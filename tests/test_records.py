import json

import pytest

from tenderloom.operators.records import RECORD_FIELDS, RECORD_SCHEMAS, flatten_records, parse_records

LONG = "x" * 600

CASES = [
    (
        "monitor",
        {"id": 1, "name": "CPU", "overall_state": "Alert", "message": LONG, "tags": ["a"], "priority": 2},
        {"id": 1, "status": "Alert", "message": "x" * 297 + "...", "tags": ["a"], "query": None},
    ),
    (
        "host",
        {"name": "web-1", "up": True, "tags_by_source": {"agent": ["env:prod"]}, "meta": {"platform": "linux"}},
        {"status": "up", "tags_by_source": {"agent": ["env:prod"]}, "platform": "linux", "apps": []},
    ),
    ("host", {"name": "web-2"}, {"status": "down", "platform": None}),
    ("event", {"id": 3, "text": None}, {"text": "", "tags": []}),
    (
        "event_v2",
        {"id": "e", "attributes": {"title": "", "evt": {"name": "deploy", "source": "ci"}, "message": LONG}},
        {"title": "deploy", "source": "ci", "message": "x" * 497 + "..."},
    ),
    (
        "incident",
        {"id": "i", "attributes": {"state": "active", "commander": {"data": {"attributes": {"name": "Kim"}}}}},
        {"status": "active", "commander": "Kim", "resolved": None},
    ),
    ("incident", {"id": "i", "attributes": {"commander": None}}, {"commander": None}),
    ("slo", {"id": "s", "thresholds": [{"target": 99.9, "timeframe": "30d"}]}, {"overall_status": []}),
    (
        "downtime",
        {"id": "d", "attributes": {"schedule": {"current_downtime": {"start": "a", "end": "b"}}}},
        {"schedule_start": "a", "schedule_end": "b"},
    ),
    ("synthetics_test", {"public_id": "p", "locations": ["aws"]}, {"locations": ["aws"], "message": ""}),
    (
        "service",
        {"attributes": {"schema": {"info": {"dd-service": "api", "team": "core"}, "tags": ["t"]}}},
        {"name": "api", "team": "core", "tags": ["t"], "links": []},
    ),
    ("dashboard", {"id": "d", "title": "T"}, {"title": "T", "description": ""}),
    ("notebook", {"id": 1, "author": {"handle": "kim"}, "cells": [{"a": 1}, {}]}, {"author": "kim", "cells_count": 2}),
    ("notebook", {"id": 1}, {"author": None, "cells_count": 0}),
    ("team", {"id": "t", "attributes": {"user_count": 5, "summary": "s"}}, {"member_count": 5, "summary": "s"}),
    ("workflow", {"id": "w", "attributes": {"state": "on"}}, {"state": "on"}),
    ("container", {"id": "c", "attributes": {"image_tag": "1"}}, {"image_tag": "1", "tags": []}),
    ("container_image", {"id": "c", "attributes": {"vulnerability_count": 3}}, {"vulnerability_count": 3}),
    (
        "security_signal",
        {"id": "s", "attributes": {"message": "m", "attributes": {"workflow": {"rule": {"name": "inner"}}}}},
        {"title": "m", "rule_name": "inner"},
    ),
    (
        "security_signal",
        {"id": "s", "attributes": {"title": "t", "message": "m", "workflow": {"rule": {"name": "outer"}}}},
        {"title": "t", "rule_name": "outer"},
    ),
    ("error_tracking_issue", {"id": "e", "attributes": {"count": 7, "env": "prod"}}, {"count": 7, "env": "prod"}),
    ("log", {"id": "l", "attributes": {"message": LONG, "service": "api"}}, {"message": "x" * 497 + "...", "tags": []}),
    (
        "span",
        {"id": "s", "attributes": {"attributes": {"duration": 5, "error_type": "", "error_message": "boom"}}},
        {"duration_ns": 5, "error": "boom"},
    ),
    ("rum", {"id": "r", "attributes": {"view": {"url": "u"}, "session": {"type": "user"}}}, {"view_url": "u", "session_type": "user", "error_message": ""}),
    ("ci", {"id": "c", "attributes": {"ci": {"git": {"commit": {"sha": "abc"}}, "pipeline": {"duration": 9}}}}, {"git_commit_sha": "abc", "duration_ms": 9}),
    ("audit", {"id": "a", "attributes": {"usr": {"email": "k@x"}, "asset": {"id": "1"}}}, {"user_email": "k@x", "asset_id": "1"}),
    ("process", {"id": "p", "attributes": {"command": LONG, "pid": 4}}, {"command": "x" * 197 + "...", "pid": 4}),
    ("usage", {"id": "u", "attributes": {"product_family": "logs"}}, {"product_family": "logs", "measurements": []}),
    ("cost", {"id": "c", "attributes": {"org_name": "o", "total_cost": 1.5}}, {"total_cost": 1.5, "charges": []}),
    ("test_result", {"result_id": "r", "dc_id": 2, "result": {"timings": {"total": 1.5}}}, {"probe_dc": 2, "response_time": 1.5}),
    ("relation", {"id": "r", "attributes": {"source": {"name": "a"}, "target": {"name": "b"}}}, {"source": "a", "target": "b"}),
    ("log_index", {"name": "main", "filter": {"query": "*"}}, {"filter": "*"}),
    ("on_call", {"id": "o", "attributes": {"timezone": "UTC"}}, {"timezone": "UTC", "layers": []}),
]


@pytest.mark.parametrize("kind, record, expected", CASES)
def test_flattening(spark, kind, record, expected):
    df = spark.createDataFrame([(json.dumps(record),)], "json STRING")
    records = parse_records(df, "json", kind)
    row = flatten_records(records, kind, cut=True).first().asDict()
    assert {k: row[k] for k in expected} == expected
    whole = flatten_records(records, kind).first().asDict()
    assert all(len(whole[k]) >= len(v) for k, v in row.items() if isinstance(v, str))


def test_every_kind_is_covered():
    assert set(RECORD_SCHEMAS) == set(RECORD_FIELDS) == {kind for kind, _, _ in CASES}
    assert len(RECORD_FIELDS) == 29


def test_empty_records_flatten(spark):
    df = spark.createDataFrame([("{}",)], "json STRING")
    for kind in RECORD_FIELDS:
        assert flatten_records(parse_records(df, "json", kind), kind).count() == 1
