"""Flat views of nested telemetry records, declared as field maps.

Each record kind has a read schema (``RECORD_SCHEMAS``) and a list of output fields
(``RECORD_FIELDS``) written ``name=path:rule``:

* ``name`` alone reads the column of that name, ``name=a.b`` reads a nested field;
* ``a|b`` takes the first path that is not empty;
* rule ``cut300`` shortens a text, ``list`` turns a missing array into an empty one,
  ``size`` counts array elements, ``updown`` maps a flag to ``up`` / ``down``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.functions.text import truncate

_TAGS = "tags ARRAY<STRING>"

# Read schemas of the record kinds (Spark DDL).
RECORD_SCHEMAS = {
    "monitor": (
        "id BIGINT, name STRING, type STRING, query STRING, overall_state STRING, "
        f"message STRING, {_TAGS}, created STRING, modified STRING, priority INT"
    ),
    "host": (
        "name STRING, id BIGINT, is_muted BOOLEAN, up BOOLEAN, apps ARRAY<STRING>, "
        "tags_by_source MAP<STRING, ARRAY<STRING>>, last_reported_time BIGINT, "
        "meta STRUCT<platform: STRING, agent_version: STRING>"
    ),
    "event": (
        "id BIGINT, title STRING, text STRING, date_happened BIGINT, source STRING, "
        f"priority STRING, alert_type STRING, {_TAGS}"
    ),
    "event_v2": (
        "id STRING, attributes STRUCT<title: STRING, message: STRING, timestamp: STRING, "
        "tags: ARRAY<STRING>, status: STRING, evt: STRUCT<name: STRING, source: STRING>>"
    ),
    "incident": (
        "id STRING, attributes STRUCT<title: STRING, state: STRING, severity: STRING, "
        "created: STRING, modified: STRING, customer_impact_scope: STRING, detected: STRING, "
        "resolved: STRING, "
        "commander: STRUCT<data: STRUCT<attributes: STRUCT<name: STRING>>>>"
    ),
    "slo": (
        f"id STRING, name STRING, type STRING, description STRING, {_TAGS}, "
        "thresholds ARRAY<STRUCT<target: DOUBLE, timeframe: STRING>>, "
        "overall_status ARRAY<STRING>, created_at BIGINT, modified_at BIGINT"
    ),
    "downtime": (
        "id STRING, attributes STRUCT<display_name: STRING, status: STRING, "
        "monitor_identifier: STRING, message: STRING, canceled: STRING, created: STRING, "
        "modified: STRING, "
        "schedule: STRUCT<current_downtime: STRUCT<start: STRING, `end`: STRING>>>"
    ),
    "synthetics_test": (
        "public_id STRING, name STRING, type STRING, subtype STRING, status STRING, "
        f"{_TAGS}, locations ARRAY<STRING>, message STRING, monitor_id BIGINT, "
        "created_at STRING, modified_at STRING"
    ),
    "service": (
        "attributes STRUCT<schema: STRUCT<`dd-service`: STRING, description: STRING, "
        "team: STRING, contacts: ARRAY<STRING>, links: ARRAY<STRING>, tags: ARRAY<STRING>, "
        "info: STRUCT<`dd-service`: STRING, description: STRING, team: STRING>>>"
    ),
    "dashboard": (
        "id STRING, title STRING, description STRING, url STRING, layout_type STRING, "
        "author_handle STRING, created_at STRING, modified_at STRING"
    ),
    "notebook": (
        "id BIGINT, name STRING, author STRUCT<handle: STRING>, status STRING, "
        "created STRING, modified STRING, cells ARRAY<STRING>"
    ),
    "team": (
        "id STRING, attributes STRUCT<name: STRING, handle: STRING, summary: STRING, "
        "description: STRING, user_count: INT, link_count: INT>"
    ),
    "workflow": (
        "id STRING, attributes STRUCT<name: STRING, description: STRING, state: STRING, "
        "created_at: STRING, modified_at: STRING>"
    ),
    "container": (
        "id STRING, attributes STRUCT<name: STRING, image_name: STRING, image_tag: STRING, "
        "state: STRING, host: STRING, started: STRING, tags: ARRAY<STRING>>"
    ),
    "container_image": (
        "id STRING, attributes STRUCT<name: STRING, tags: ARRAY<STRING>, image_id: STRING, "
        "repo_digest: STRING, short_image: STRING, os_name: STRING, os_version: STRING, "
        "vulnerability_count: INT>"
    ),
    "security_signal": (
        "id STRING, attributes STRUCT<title: STRING, message: STRING, status: STRING, "
        "severity: STRING, timestamp: STRING, source: STRING, tags: ARRAY<STRING>, "
        "workflow: STRUCT<rule: STRUCT<name: STRING>>, "
        "attributes: STRUCT<workflow: STRUCT<rule: STRUCT<name: STRING>>>>"
    ),
    "error_tracking_issue": (
        "id STRING, attributes STRUCT<title: STRING, status: STRING, level: STRING, "
        "first_seen: STRING, last_seen: STRING, count: BIGINT, service: STRING, env: STRING, "
        "platform: STRING>"
    ),
    "log": (
        "id STRING, attributes STRUCT<timestamp: STRING, status: STRING, service: STRING, "
        "message: STRING, host: STRING, tags: ARRAY<STRING>>"
    ),
    "span": (
        "id STRING, attributes STRUCT<service: STRING, host: STRING, timestamp: STRING, "
        "attributes: STRUCT<trace_id: STRING, span_id: STRING, resource_name: STRING, "
        "operation_name: STRING, duration: BIGINT, status: STRING, error_type: STRING, "
        "error_message: STRING>>"
    ),
    "rum": (
        "id STRING, attributes STRUCT<type: STRING, timestamp: STRING, tags: ARRAY<STRING>, "
        "application: STRUCT<name: STRING>, view: STRUCT<url: STRING>, "
        "action: STRUCT<type: STRING>, error: STRUCT<message: STRING>, "
        "session: STRUCT<type: STRING>>"
    ),
    "ci": (
        "id STRING, attributes STRUCT<timestamp: STRING, ci: STRUCT<status: STRING, "
        "level: STRING, pipeline: STRUCT<name: STRING, duration: BIGINT>, "
        "provider: STRUCT<name: STRING>, "
        "git: STRUCT<branch: STRING, commit: STRUCT<sha: STRING>>>>"
    ),
    "audit": (
        "id STRING, attributes STRUCT<timestamp: STRING, evt: STRUCT<name: STRING>, "
        "usr: STRUCT<email: STRING, name: STRING>, "
        "asset: STRUCT<type: STRING, id: STRING, name: STRING>, org: STRUCT<id: STRING>>"
    ),
    "process": (
        "id STRING, attributes STRUCT<name: STRING, pid: BIGINT, host: STRING, "
        "command: STRING, user: STRING, cpu_percent: DOUBLE, memory_rss: BIGINT, "
        "state: STRING, started: STRING, tags: ARRAY<STRING>>"
    ),
    "usage": (
        "id STRING, attributes STRUCT<product_family: STRING, timestamp: STRING, "
        "org_name: STRING, measurements: ARRAY<STRUCT<usage_type: STRING, value: DOUBLE>>>"
    ),
    "cost": (
        "id STRING, attributes STRUCT<org_name: STRING, date: STRING, total_cost: DOUBLE, "
        "charges: ARRAY<STRUCT<product_name: STRING, charge_type: STRING, cost: DOUBLE>>>"
    ),
    "test_result": (
        "result_id STRING, status INT, check_time BIGINT, dc_id BIGINT, "
        "result STRUCT<timings: STRUCT<total: DOUBLE>>"
    ),
    "relation": (
        "id STRING, attributes STRUCT<type: STRING, source: STRUCT<name: STRING>, "
        "target: STRUCT<name: STRING>>"
    ),
    "log_index": (
        "name STRING, filter STRUCT<query: STRING>, num_retention_days BIGINT, "
        "daily_limit BIGINT, is_rate_limited BOOLEAN"
    ),
    "on_call": (
        "id STRING, attributes STRUCT<name: STRING, timezone: STRING, layers: ARRAY<STRING>, "
        "created_at: STRING, modified_at: STRING>"
    ),
}

# Output fields of the record kinds. ``@`` stands for ``attributes.``.
RECORD_FIELDS = {
    "monitor": (
        "id name type query status=overall_state message=message:cut300 tags=tags:list "
        "created modified priority"
    ),
    "host": (
        "name id is_muted status=up:updown apps=apps:list tags_by_source "
        "last_reported=last_reported_time platform=meta.platform agent_version=meta.agent_version"
    ),
    "event": "id title text=text:cut500 date_happened source priority alert_type tags=tags:list",
    "event_v2": (
        "id title=@title|@evt.name message=@message:cut500 timestamp=@timestamp "
        "tags=@tags:list source=@evt.source status=@status"
    ),
    "incident": (
        "id title=@title status=@state severity=@severity created=@created modified=@modified "
        "commander=@commander.data.attributes.name customer_impact=@customer_impact_scope "
        "detected=@detected resolved=@resolved"
    ),
    "slo": (
        "id name type description=description:cut300 tags=tags:list thresholds=thresholds:list "
        "overall_status=overall_status:list created_at modified_at"
    ),
    "downtime": (
        "id display_name=@display_name status=@status scope=@monitor_identifier "
        "message=@message:cut300 schedule_start=@schedule.current_downtime.start "
        "schedule_end=@schedule.current_downtime.end canceled=@canceled created=@created "
        "modified=@modified"
    ),
    "synthetics_test": (
        "public_id name type subtype status tags=tags:list locations=locations:list "
        "message=message:cut300 monitor_id created_at modified_at"
    ),
    "service": (
        "name=@schema.dd-service|@schema.info.dd-service "
        "description=@schema.description|@schema.info.description:cut300 "
        "team=@schema.team|@schema.info.team contacts=@schema.contacts:list "
        "links=@schema.links:list tags=@schema.tags:list"
    ),
    "dashboard": (
        "id title description=description:cut300 url layout_type author_handle created_at "
        "modified_at"
    ),
    "notebook": "id name author=author.handle status created modified cells_count=cells:size",
    "team": (
        "id name=@name handle=@handle summary=@summary:cut300 description=@description:cut300 "
        "member_count=@user_count link_count=@link_count"
    ),
    "workflow": (
        "id name=@name description=@description:cut300 state=@state created_at=@created_at "
        "modified_at=@modified_at"
    ),
    "container": (
        "id name=@name image_name=@image_name image_tag=@image_tag state=@state host=@host "
        "started=@started tags=@tags:list"
    ),
    "container_image": (
        "id name=@name tags=@tags:list image_id=@image_id repo_digest=@repo_digest "
        "short_image=@short_image os_name=@os_name os_version=@os_version "
        "vulnerability_count=@vulnerability_count"
    ),
    "security_signal": (
        "id title=@title|@message:cut200 status=@status severity=@severity "
        "timestamp=@timestamp source=@source tags=@tags:list "
        "rule_name=@workflow.rule.name|@attributes.workflow.rule.name"
    ),
    "error_tracking_issue": (
        "id title=@title status=@status level=@level first_seen=@first_seen "
        "last_seen=@last_seen count=@count service=@service env=@env platform=@platform"
    ),
    "log": (
        "id timestamp=@timestamp status=@status service=@service message=@message:cut500 "
        "host=@host tags=@tags:list"
    ),
    "span": (
        "id trace_id=@attributes.trace_id span_id=@attributes.span_id service=@service "
        "resource_name=@attributes.resource_name operation_name=@attributes.operation_name "
        "duration_ns=@attributes.duration status=@attributes.status host=@host "
        "timestamp=@timestamp error=@attributes.error_type|@attributes.error_message"
    ),
    "rum": (
        "id type=@type timestamp=@timestamp application=@application.name view_url=@view.url "
        "action_type=@action.type error_message=@error.message:cut300 "
        "session_type=@session.type tags=@tags:list"
    ),
    "ci": (
        "id pipeline_name=@ci.pipeline.name status=@ci.status level=@ci.level "
        "provider=@ci.provider.name duration_ms=@ci.pipeline.duration git_branch=@ci.git.branch "
        "git_commit_sha=@ci.git.commit.sha timestamp=@timestamp"
    ),
    "audit": (
        "id timestamp=@timestamp action=@evt.name user_email=@usr.email user_name=@usr.name "
        "asset_type=@asset.type asset_id=@asset.id asset_name=@asset.name org_id=@org.id"
    ),
    "process": (
        "id name=@name pid=@pid host=@host command=@command:cut200 user=@user "
        "cpu_percent=@cpu_percent memory_rss=@memory_rss state=@state started=@started "
        "tags=@tags:list"
    ),
    "usage": (
        "id product_family=@product_family timestamp=@timestamp org_name=@org_name "
        "measurements=@measurements:list"
    ),
    "cost": "id org_name=@org_name date=@date total_cost=@total_cost charges=@charges:list",
    "test_result": (
        "result_id status check_time probe_dc=dc_id response_time=result.timings.total"
    ),
    "relation": "id type=@type source=@source.name target=@target.name",
    "log_index": "name filter=filter.query num_retention_days daily_limit is_rate_limited",
    "on_call": (
        "id name=@name timezone=@timezone layers=@layers:list created_at=@created_at "
        "modified_at=@modified_at"
    ),
}


def record_schema(kind: str) -> T.StructType:
    return T.StructType.fromDDL(RECORD_SCHEMAS[kind])


def _path(path: str) -> Column:
    steps = path.replace("@", "attributes.").split(".")
    column = F.col(f"`{steps[0]}`")
    for step in steps[1:]:
        column = column.getField(step)
    return column


def _field(spec: str, cut: bool) -> Column:
    name, _, source = spec.partition("=")
    paths, _, rule = (source or name).partition(":")
    options = [_path(path) for path in paths.split("|")]
    # Empty texts give way to the next path.
    value = options[-1]
    for option in reversed(options[:-1]):
        value = F.when(F.length(option) > 0, option).otherwise(value)
    if rule.startswith("cut"):
        value = truncate(value, int(rule[3:])) if cut else F.coalesce(value, F.lit(""))
    elif rule == "list":
        value = F.coalesce(value, F.array())
    elif rule == "size":
        value = F.coalesce(F.array_size(value), F.lit(0))
    elif rule == "updown":
        value = F.when(value, "up").otherwise("down")
    return value.alias(name)


def flatten_records(df: DataFrame, kind: str, cut: bool = False) -> DataFrame:
    """Nested records of a kind -> one flat row each; missing fields are NULL.

    Texts stay whole; ``cut`` shortens the long ones for display.
    """
    return df.select(*[_field(spec, cut) for spec in RECORD_FIELDS[kind].split()])


def parse_records(df: DataFrame, json: str, kind: str) -> DataFrame:
    """JSON text column -> nested record columns of a kind."""
    return df.select(F.from_json(json, record_schema(kind)).alias("r")).select("r.*")
