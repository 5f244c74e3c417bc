"""DuckDB twins for selection, framework, quality, snapshot, source and stream keys."""

from __future__ import annotations

from vigil import oracle as O
from vigil.sources.fixtures import duckdb_with

NOT_USER = "('master', 'tempdb', 'model', 'msdb')"


def w(views, body: str) -> str:
    return duckdb_with(views) + body


SEL = "select server_id, name as db_name, cast(state as integer) as db_state from fx_databases"

GUID_HEX = ("substr(upper(job_id),7,2) || substr(upper(job_id),5,2) || substr(upper(job_id),3,2) || substr(upper(job_id),1,2)"
            " || substr(upper(job_id),12,2) || substr(upper(job_id),10,2) || substr(upper(job_id),17,2)"
            " || substr(upper(job_id),15,2) || substr(upper(job_id),20,4) || substr(upper(job_id),25,12)")

ACTIVITY = f"""activity as (
with r as (select * from fx_requests where command is not null and coalesce(wait_type, '') <> 'BROKER_RECEIVE_WAITFOR'),
s as (select * from fx_sessions where is_user_process),
js as (select distinct server_id, session_id, unhex(substr(substr(program_name, 30, 34), 3, 32)) as job_id_vb,
  try_cast(substr(program_name, 72, length(program_name) - 72) as integer) as step_id
  from fx_sessions where program_name like 'SQLAgent - TSQL JobStep%'),
j as (select server_id, job_key, unhex({GUID_HEX}) as job_id_vb, name as job_name from fx_jobs),
res as (select js.server_id, js.session_id, j.job_name, js.step_id, st.step_name from js
  left join j on j.server_id = js.server_id and j.job_id_vb = js.job_id_vb
  left join fx_job_steps st on st.server_id = js.server_id and st.job_key = j.job_key and st.step_id = js.step_id)
select r.snap_ts as snap_time_stamp, r.server_id, r.session_id, r.request_id, s.login_name,
  coalesce('Job "' || res.job_name || '" : Step ' || cast(res.step_id as varchar) || ' "' || res.step_name || '"',
           s.program_name) as program_name,
  d.name as dbname, r.start_time,
  cast(epoch(date_trunc('second', r.snap_ts)) - epoch(date_trunc('second', r.start_time)) as bigint) as duration_sec,
  r.command, r.status, r.last_wait_type, r.wait_time, left(r.sql_text, 1000) as sql_text
from r join s on s.server_id = r.server_id and s.session_id = r.session_id
left join res on res.server_id = r.server_id and res.session_id = r.session_id
left join fx_databases d on d.server_id = r.server_id and d.database_id = r.database_id)
"""
ACTIVITY_VIEWS = ["fx_requests", "fx_sessions", "fx_jobs", "fx_job_steps", "fx_databases"]

ALERTS = """alerts as (select * from (values ('Fleet Filegroup Overflow', 1105, 0), ('Fleet TX Log Full', 9002, 0),
  ('Fleet No Catalog Entry Found', 608, 0), ('Fleet Severity 21 Errors', 0, 21)) t(alert_name, rule_message_id, rule_severity)),
matches as (select e.event_id, e.server_id, e.ts, a.alert_name, e.message_id, e.severity
  from fx_xe_events e join alerts a on a.rule_message_id <> 0 and e.message_id = a.rule_message_id
  union all
  select e.event_id, e.server_id, e.ts, a.alert_name, e.message_id, e.severity
  from fx_xe_events e join alerts a on a.rule_severity <> 0 and e.severity = a.rule_severity)
"""

# the responses along {matches}: each the first event a delay or more after the one before
THROTTLE = """,
fires(server_id, alert_name, fire_ts) as (
  select server_id, alert_name, min(ts) from {matches} group by server_id, alert_name
  union all
  select f.server_id, f.alert_name, (select min(m.ts) from {matches} m where m.server_id = f.server_id
    and m.alert_name = f.alert_name and m.ts >= f.fire_ts + interval 3600 second)
  from fires f where f.fire_ts is not null)
select m.event_id, m.server_id, m.alert_name, m.ts from fires f
join (select *, row_number() over (partition by server_id, alert_name, ts order by event_id) as rn from {matches}) m
  on m.server_id = f.server_id and m.alert_name = f.alert_name and m.ts = f.fire_ts and m.rn = 1"""

WAIT_NAMES = "('BROKER_EVENTHANDLER', 'BROKER_RECEIVE_WAITFOR', 'DBMIRRORING_CMD', 'BROKER_TRANSMITTER', 'CXPACKET', 'DBMIRROR_EVENTS_QUEUE')"
WAITS = f"event_name = 'wait_info' and duration_ms > 15000 and session_id > 50 and wait_type not in {WAIT_NAMES}"
COUNTER_RX = r"'^\\([^\\(]+)(?:\(([^)]*)\))?\\(.+)$'"


def _report_with(filter_sql: str = "", registry: str | None = None, excl: str | None = None) -> str:
    sql = O._policy_ctes(sorted(O.POLICY_SQL), ["fx_registry", "fx_exclusions"] if registry else [])
    if registry:
        sql = sql.replace(f"registry as ({O.registry_values()})", f"registry as ({registry})")
    if excl:
        sql = sql.replace(f"excl as ({O.exclusion_values()})", f"excl as ({excl})")
    return sql + f""", rep as (select server_id,
  row_number() over (partition by server_id order by processing_order, policy_no,
    case when db_level then lower(db_name) end nulls first, case when db_level then db_name end nulls first,
    stmt_no, log_order desc nulls last, log_date nulls first, db_name nulls first, message) as seq,
  policy_no, policy_name, db_name, message
from elig where is_active {filter_sql})
"""


def _registered() -> tuple[str, str]:
    defaults = O.registry_values()
    registry = (f"select * from fx_registry union all select * from ({defaults}) d "
                f"where d.policy_no not in (select policy_no from fx_registry)")
    excl = (f"select * from fx_exclusions union all select * from ({O.exclusion_values()}) e "
            f"where e.policy_no not in (select policy_no from fx_registry)")
    return registry, excl


def _cell(c: str) -> str:
    return (f"'<td>' || coalesce(replace(replace(replace(cast({c} as varchar), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '') || '</td>'")


def sql() -> dict[str, str]:
    reg_sql, exc_sql = _registered()
    html_row = f"'<tr>' || {_cell('seq')} || {_cell('policy_name')} || {_cell('db_name')} || {_cell('message')} || '</tr>'"
    head = "'<table><tr><th>Order</th><th>Policy Name</th><th>Affected DB</th><th>Message</th></tr>'"
    out = {
        "select_system": w(["fx_servers"], "select server_id, n as db_name, 0 as db_state from fx_servers "
                                           "cross join (values ('master'), ('model'), ('msdb')) t(n)"),
        "select_user": w(["fx_databases"], f"{SEL} where lower(name) not in {NOT_USER}"),
        "select_all": w(["fx_databases"], SEL),
        "select_list": w(["fx_databases"], "select d.server_id, d.name as db_name, cast(d.state as integer) as db_state "
                                           "from fx_databases d join (values ('master'), ('db_4'), ('db_4'), ('tempdb'), ('')) "
                                           "t(k) on lower(d.name) = t.k"),
        "select_list_config": w(["fx_databases", "fx_config"],
                                "select d.server_id, d.name as db_name, cast(d.state as integer) as db_state "
                                "from fx_databases d join (select lower(trim(unnest(string_split(value, ',')))) as k "
                                "from fx_config where name = 'base.database_list') t on lower(d.name) = t.k"),
        "select_exact": w(["fx_databases"], f"{SEL} where lower(name) = 'reportserver'"),
        "for_each_online": w(["fx_databases", "fx_servers"], f""", cnt as (
  select server_id, count(*) filter (where state <> 0) as n_offline from fx_databases
  where lower(name) not in {NOT_USER} group by server_id)
select s.server_id, d.name as db_name, coalesce(c.n_offline, 0)::bigint as n_offline, 0::bigint as n_read_only
from fx_servers s left join cnt c on c.server_id = s.server_id
left join fx_databases d on d.server_id = s.server_id and d.state = 0 and lower(d.name) not in {NOT_USER}"""),
        "for_each_writable": w(["fx_databases", "fx_servers"], f""", cnt as (
  select server_id, count(*) filter (where state <> 0) as n_offline,
         count(*) filter (where state = 0 and is_read_only) as n_read_only from fx_databases
  where lower(name) not in {NOT_USER} group by server_id)
select s.server_id, d.name as db_name, coalesce(c.n_offline, 0)::bigint as n_offline,
       coalesce(c.n_read_only, 0)::bigint as n_read_only
from fx_servers s left join cnt c on c.server_id = s.server_id
left join fx_databases d on d.server_id = s.server_id and d.state = 0 and not coalesce(d.is_read_only, false)
  and lower(d.name) not in {NOT_USER}"""),
        "for_each_list": w(["fx_databases"], f""", sel as ({SEL}),
cnt as (select server_id, count(*) - count(*) filter (where db_state = 0) as n_skipped from sel group by server_id)
select s.server_id, left(s.db_name, 40) as name, d.database_id as id from sel s
left join fx_databases d on d.server_id = s.server_id and lower(d.name) = lower(s.db_name) where s.db_state = 0"""),
        "csv_rows": """select doc_id, cast(pos as integer) as pos, trim(item) as item from (
  select doc_id, unnest(string_split(text, ',')) as item, unnest(range(len(string_split(text, ',')))) as pos
  from documents where text is not null)""",
        "policy_eligibility": w(["fx_databases", "fx_registry", "fx_exclusions"], """select d.server_id, r.policy_no, d.name as db_name
from fx_databases d join fx_registry r on not r.is_server_level and r.is_active and (not r.online_only or d.state = 0)
where not exists (select 1 from fx_exclusions x where x.policy_no = r.policy_no
  and regexp_full_match(d.name, '(?is)' || replace(replace(x.pattern, '%', '.*'), '_', '.')))"""),
        "filter_intersect": _report_with("and policy_no in (1, 3, 9, 99)") + "select * from rep",
        "filter_except": _report_with("and policy_no not in (1, 2, 5, 19, 22)") + "select * from rep",
        "register_policies": _report_with(registry=reg_sql, excl=exc_sql) + "select * from rep",
        "policy_counts": _report_with() + "select server_id, count(*) as n_messages from rep group by server_id",
        "report_html": _report_with() + f"""select server_id, (seq - 1) // 1000 + 1 as page, count(*) as n_messages,
  {head} || string_agg({html_row}, '' order by seq) || '</table>' as html from rep group by server_id, (seq - 1) // 1000 + 1""",
        "custom_policy": w(["fx_databases"], """select server_id, 30 as policy_no, name as db_name, 1 as stmt_no,
  'READ_ONLY=ON' as message from fx_databases where is_read_only"""),
        "dq_unique": w(["fx_databases", "fx_files"], """select 'databases(server_id, name)' as constraint_name,
  concat_ws('|', cast(server_id as varchar), lower(name)) as key_value, count(*) as n_rows
from fx_databases group by server_id, lower(name) having count(*) > 1
union all
select 'files(server_id, db_key, file_id)', concat_ws('|', cast(server_id as varchar), cast(db_key as varchar), cast(file_id as varchar)),
  count(*) from fx_files group by server_id, db_key, file_id having count(*) > 1"""),
        "dq_fk": w(["fx_requests", "fx_databases", "fx_job_steps", "fx_jobs"], """select 'requests -> databases' as constraint_name,
  r.server_id, cast(r.database_id as bigint) as key_id from fx_requests r
where not exists (select 1 from fx_databases d where d.server_id = r.server_id and d.database_id = r.database_id)
union all
select 'job_steps -> jobs', s.server_id, s.job_key from fx_job_steps s
where not exists (select 1 from fx_jobs j where j.server_id = s.server_id and j.job_key = s.job_key)"""),
        "activity_snapshot": duckdb_with(ACTIVITY_VIEWS) + ", " + ACTIVITY + "select * from activity",
        "job_inventory": w(["fx_jobs", "fx_categories", "fx_principals"], """select j.server_id, j.job_id, j.name, p.name as owner,
  c.name as category, nullif(j.description, 'No description available.') as description, j.enabled,
  j.start_step_id, j.delete_level, j.date_created, j.date_modified, j.version_number
from fx_jobs j join fx_categories c on c.category_id = j.category_id
left join fx_principals p on p.server_id = j.server_id and p.owner_sid = j.owner_sid"""),
        "step_inventory": w(["fx_job_steps", "fx_jobs"], """select st.server_id, j.job_id, st.step_id, st.step_name, st.subsystem,
  left(st.command, 1000) as command, st.cmdexec_success_code, st.on_success_action, st.on_success_step_id, st.on_fail_action, st.on_fail_step_id,
  st.server, st.database_name, st.database_user_name, st.retry_attempts, st.retry_interval, st.output_file_name, st.proxy_id from fx_job_steps st join fx_jobs j on j.server_id = st.server_id and j.job_key = st.job_key"""),
        "snapshot_retention": duckdb_with(ACTIVITY_VIEWS) + ", " + ACTIVITY + """select * from activity
where cast((select max(ts) from events) as date) - cast(snap_time_stamp as date) < 14""",
        "disk_space": w(["fx_volumes", "fx_volume_bounds"], """select v.server_id, v.name as volume_name,
  cast(v.capacity - v.free_space as bigint) * 100.0::double / v.capacity as used_pct,
  coalesce(cast(b.warning_pct as double), 80.0::double) as warning_pct, coalesce(cast(b.error_pct as double), 90.0::double) as error_pct,
  case when cast(v.capacity - v.free_space as bigint) * 100.0::double / v.capacity >= coalesce(cast(b.error_pct as double), 90.0::double) then 'ERROR'
       when cast(v.capacity - v.free_space as bigint) * 100.0::double / v.capacity >= coalesce(cast(b.warning_pct as double), 80.0::double) then 'WARNING'
       else 'OK' end as status
from fx_volumes v left join fx_volume_bounds b on upper(b.volume_name) = upper(v.name)"""),
        "backup_retention": w(["fx_backup_files", "fx_databases", "fx_retention_overrides", "fx_config"], f"""select * from (
select f.server_id, d.name as db_name, f.file_name, f.last_write_time, f.size_bytes,
  cast(coalesce(o.retention_days, try_cast(c.v as integer), 4) as integer) as retention_days
from fx_backup_files f left join fx_databases d on d.server_id = f.server_id and d.db_key = f.db_key
left join fx_retention_overrides o on lower(d.name) = lower(o.db_name)
cross join (select max(case when name = 'maint.backup_retention_days' then value end) as v from fx_config) c) x
where cast(timestamp '{O.AS_OF}' as date) - cast(last_write_time as date) > retention_days"""),
        "file_plan": w(["fx_files", "fx_databases"], """select f.server_id, d.name as db_name, f.name as file_name, f.size_pages * 8 as current_kb,
  'ALTER DATABASE [' || d.name || '] MODIFY FILE (NAME=N''' || f.name || ''', '
  || case when t.new_size_kb > f.size_pages * 8 then 'SIZE = ' || t.new_size_kb || 'KB, ' else '' end
  || 'MAXSIZE=UNLIMITED, FILEGROWTH=' || t.new_growth_kb || 'KB)' as statement
from fx_files f join fx_databases d on d.server_id = f.server_id and d.db_key = f.db_key
join (select * from (values ('model', 51200, 102400), ('msdb', null, 51200), ('tempdb', null, 102400)) t(k, new_size_kb, new_growth_kb)) t
  on lower(d.name) = t.k"""),
        "job_log_names": w(["fx_job_steps", "fx_jobs"], """select st.server_id, st.job_key, j.name as job_name, st.step_id, st.output_file_name,
  translate(j.name, '.\\/:*?<>|', '_________') as expected_name
from fx_job_steps st join fx_jobs j on j.server_id = st.server_id and j.job_key = st.job_key
where st.output_file_name is not null
  and lower(regexp_replace(regexp_extract(st.output_file_name, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''))
      <> lower(translate(j.name, '.\\/:*?<>|', '_________'))"""),
        "volume_scan": w(["fx_volumes"], "select server_id, cast(volume_no as integer) as volume_no, name, capacity, free_space from fx_volumes"),
        "xe_waits": w(["fx_xe_events"], f"select * from fx_xe_events where {WAITS}"),
        "xe_events": w(["fx_xe_events"], "select * replace (" + ", ".join(
            f"case when event_name = 'wait_info' then {c} end as {c}" for c in ("client_app_name", "client_hostname", "database_name", "sql_text", "username"))
            + f") from fx_xe_events where ({WAITS}) or event_name in ('blocked_process_report', 'xml_deadlock_report')"),
        "alert_match": duckdb_with(["fx_xe_events"]) + ", " + ALERTS + "select * from matches",
        "alert_throttle": duckdb_with(["fx_xe_events"]).replace("with ", "with recursive ", 1) + ", " + ALERTS + THROTTLE.format(matches="matches"),
        "activity_rollup": duckdb_with(ACTIVITY_VIEWS) + ", " + ACTIVITY + """select server_id,
  time_bucket(interval '15 minutes', snap_time_stamp) as window_start,
  time_bucket(interval '15 minutes', snap_time_stamp) + interval '15 minutes' as window_end,
  count(*) as n_requests, cast(sum(duration_sec) as bigint) as sum_duration_sec, max(duration_sec) as max_duration_sec
from activity group by server_id, time_bucket(interval '15 minutes', snap_time_stamp)""",
        "perf_rollup": w(["fx_perf_samples"], f"""select server_id, time_bucket(interval '60 seconds', ts) as window_start,
  regexp_extract(counter_path, {COUNTER_RX}, 1) as object,
  nullif(regexp_extract(counter_path, {COUNTER_RX}, 2), '') as instance,
  regexp_extract(counter_path, {COUNTER_RX}, 3) as counter,
  count(*) as n_samples, avg(value) as avg_value, min(value) as min_value, max(value) as max_value
from fx_perf_samples group by 1, 2, 3, 4, 5"""),
    }
    out.update(_per_server())
    out.update(_versioned())
    out["volume_inventory"] = w(["fx_volume_inventory", "fx_servers"], """select s.server_id, v.name, v.label, v.capacity, v.free_space, v.drive_type
from fx_volume_inventory v join fx_servers s on s.machine_name = v.node where v.drive_type = 3""")
    out["eligibility_many_patterns"] = w(["fx_databases", "fx_registry", "fx_like_exclusions"], """select d.server_id, r.policy_no, d.name as db_name
from fx_databases d join fx_registry r on not r.is_server_level and r.is_active and (not r.online_only or d.state = 0)
where not exists (select 1 from fx_like_exclusions x where x.policy_no = r.policy_no and d.name ilike replace(x.pattern, '[_]', '$_') escape '$')""")
    listed = O._policy_ctes([20], ["fx_like_exclusions"]).replace(f"excl as ({O.exclusion_values()})", "excl as (select * from fx_like_exclusions)")
    out["pol_20_listed"] = listed + "select server_id, policy_no, db_name, stmt_no, message from elig"
    out["alert_throttle_hot"] = duckdb_with(["fx_alert_matches"]).replace("with ", "with recursive ", 1) + THROTTLE.format(matches="fx_alert_matches")
    out["activity_rollup_dense"] = w(["fx_activity"], """select server_id, time_bucket(interval '15 minutes', snap_time_stamp) as window_start,
  time_bucket(interval '15 minutes', snap_time_stamp) + interval '15 minutes' as window_end,
  count(*) as n_requests, cast(sum(duration_sec) as bigint) as sum_duration_sec, max(duration_sec) as max_duration_sec
from fx_activity group by 1, 2, 3""")
    out["counter_rollup"] = w(["fx_counter_samples"], COUNTER_ROLLUP)
    return out


# the collected counters, each as a pattern of its paths
COUNTER_ROLLUP = r""", wanted as (select * from (values
  (1, '^\\memory\\pages/sec$'), (2, '^\\system\\processor queue length$'), (3, '^\\processor\([^)]+\)\\% processor time$'),
  (4, '^\\memory\\available mbytes$'), (5, '^\\network interface\\bytes total/sec$'), (6, '^\\physicaldisk\(_total\)\\% disk time$'),
  (7, '^\\physicaldisk\(_total\)\\avg\. disk queue length$'), (8, '^\\(mssql\$[^:]+|sqlserver):buffer manager\\buffer cache hit ratio$'),
  (9, '^\\(mssql\$[^:]+|sqlserver):buffer manager\\page life expectancy$'), (10, '^\\(mssql\$[^:]+|sqlserver):databases\(_total\)\\transactions/sec$'),
  (11, '^\\(mssql\$[^:]+|sqlserver):general statistics\\user connections$'), (12, '^\\(mssql\$[^:]+|sqlserver):memory manager\\total server memory \(kb\)$'),
  (13, '^\\(mssql\$[^:]+|sqlserver):sql statistics\\batch requests/sec$'), (14, '^\\(mssql\$[^:]+|sqlserver):sql statistics\\sql compilations/sec$'),
  (15, '^\\(mssql\$[^:]+|sqlserver):sql statistics\\sql re-compilations/sec$')) t(counter_no, rx)),
s as (select c.*, w.counter_no, split_part(c.counter_path, chr(92), 2) as head, split_part(c.counter_path, chr(92), 3) as counter
  from fx_counter_samples c join wanted w on regexp_matches(lower(c.counter_path), w.rx)),
p as (select *, split_part(head, '(', 1) as own, nullif(rtrim(split_part(head, '(', 2), ')'), '') as instance from s)
select server_id, time_bucket(interval '60 seconds', ts) as window_start, counter_no,
  case when strpos(own, ':') > 0 then 'SQLServer' else 'System' end as collector,
  case when starts_with(own, 'MSSQL$') then split_part(substr(own, 7), ':', 1) when strpos(own, ':') > 0 then 'MSSQLSERVER' end as sql_instance,
  case when strpos(own, ':') > 0 then split_part(own, ':', 2) else own end as object, instance, counter,
  count(*) as n_samples, sum(cast(value as decimal(28,6)))::double / count(value) as avg_value, min(value) as min_value, max(value) as max_value
from p group by 1, 2, 3, 4, 5, 6, 7, 8"""

# names of settings and the column of O.CFG they become
SETTINGS = {"pol.allow_sharepoint": "allow_sp", "pol.allowed_max_vlf": "max_vlf", "pol.required_maxdop": "maxdop"}


def _per_server() -> dict[str, str]:
    """Twins over settings of single servers."""
    own = lambda n: (f"coalesce(max(case when o.name = '{n}' then o.value end), "
                     f"(select max(value) from fx_config where name = '{n}'))")
    cfg = ("select s.server_id, " + ", ".join(f"try_cast({own(n)} as integer) as {c}" for n, c in SETTINGS.items())
           + " from fx_servers s left join fx_server_config o on o.server_id = s.server_id group by s.server_id")
    out = {}
    for number, side in ((3, "d"), (16, "s"), (18, "d")):
        sql = O._policy_ctes([number], ["fx_server_config"]).replace(f"cfg as ({O.CFG})", f"cfg as ({cfg})")
        out[f"pol_{number:02d}_per_server"] = (sql.replace("cross join cfg c", f"join cfg c on c.server_id = {side}.server_id")
                                               + "select server_id, policy_no, db_name, stmt_no, message from elig")
    names = ["pol.allow_sharepoint", "pol.allowed_max_vlf", "pol.required_maxdop", "pol.mirr_safety_level",
             "pol.mirr_conn_timeout", "pol.mirr_partner_name", "maint.backup_retention_days"]
    listed = ", ".join(f"('{n}')" for n in names)
    out["server_settings"] = w(["fx_servers", "fx_server_config", "fx_config"], f"""select s.server_id, n.name,
  coalesce(o.value, c.value) as value, o.value is not null as is_own
from fx_servers s cross join (values {listed}) n(name) left join fx_server_config o on o.server_id = s.server_id and o.name = n.name
left join fx_config c on c.name = n.name where coalesce(o.value, c.value) is not null""")
    used = "cast(v.capacity - v.free_space as bigint) * 100.0::double / v.capacity"
    out["disk_space_per_server"] = w(["fx_volumes", "fx_volume_bounds", "fx_server_volume_bounds"], f"""select server_id, volume_name, used_pct, warning_pct, error_pct,
  case when used_pct >= error_pct then 'ERROR' when used_pct >= warning_pct then 'WARNING' else 'OK' end as status from (
select v.server_id, v.name as volume_name, {used} as used_pct,
  cast(case when o.server_id is not null then o.warning_pct else coalesce(b.warning_pct, 80) end as double) as warning_pct,
  cast(case when o.server_id is not null then o.error_pct else coalesce(b.error_pct, 90) end as double) as error_pct
from fx_volumes v left join fx_volume_bounds b on upper(b.volume_name) = upper(v.name)
left join fx_server_volume_bounds o on o.server_id = v.server_id and upper(o.volume_name) = upper(v.name))""")
    days = "maint.backup_retention_days"
    out["backup_retention_per_server"] = w(["fx_backup_files", "fx_databases", "fx_retention_overrides", "fx_config", "fx_server_config", "fx_server_retention"],
                                           f"""select * from (
select f.server_id, d.name as db_name, f.file_name, f.last_write_time, f.size_bytes,
  cast(coalesce(r.retention_days, o.retention_days, try_cast(sc.value as integer),
    try_cast((select max(value) from fx_config where name = '{days}') as integer), 4) as integer) as retention_days
from fx_backup_files f left join fx_databases d on d.server_id = f.server_id and d.db_key = f.db_key
left join fx_retention_overrides o on lower(d.name) = lower(o.db_name)
left join fx_server_retention r on r.server_id = f.server_id and lower(r.db_name) = lower(d.name)
left join fx_server_config sc on sc.server_id = f.server_id and sc.name = '{days}') x
where cast(timestamp '{O.AS_OF}' as date) - cast(last_write_time as date) > retention_days""")
    return out


def _versioned() -> dict[str, str]:
    """Twins of the keys that go through a versioned table."""
    number = "cast(left(job_id, 8) as integer)"
    cols = "server_id, job_id, name, enabled, version_number"
    return {
        "config_retention": w(["fx_job_history"], f"""select * from fx_job_history where snap_time_stamp <= timestamp '{O.AS_OF}'
  and cast(timestamp '{O.AS_OF}' as date) - cast(snap_time_stamp as date) < 365"""),
        "counter_folders": w(["fx_counter_samples"], """select c.* from fx_counter_samples c join (
  select server_id, day, row_number() over (partition by server_id order by day desc) as n
  from (select distinct server_id, cast(ts as date) as day from fx_counter_samples)) f
  on f.server_id = c.server_id and f.day = cast(c.ts as date) and f.n <= 14"""),
        "upsert_inventory": w(["fx_jobs"], f""", was as (select {cols} from fx_jobs where {number} % 10 <> 3),
upd as (select server_id, job_id, name || ' (v2)' as name, not enabled as enabled, version_number + 1 as version_number from fx_jobs where {number} % 4 = 3)
select * from upd union all
select * from was where not exists (select 1 from upd where upd.server_id = was.server_id and upd.job_id = was.job_id)"""),
    }
