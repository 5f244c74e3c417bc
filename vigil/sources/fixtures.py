"""``fx_*`` views: the driver's tables reshaped into the catalogs a fleet check reads.

The SQL is FIXTURES.md verbatim except that table names are ``{placeholders}``.
Spark fills a placeholder with a DataFrame (``spark.sql(text, name=df)``), the
DuckDB twin fills it with the view name, so both engines run the same text.
"""

from __future__ import annotations

import string

FIXTURE_SQL: dict[str, str] = {
    "fx_servers": """
select c_custkey as server_id, concat('HOST', c_custkey) as machine_name,
 case when c_custkey % 5 = 0 then concat('INST', c_custkey % 7) end as instance_name,
 case when c_custkey % 17 = 0 then null when c_custkey % 13 = 0 then concat('OLD', c_custkey)
      when c_custkey % 5 = 0 then concat('HOST', c_custkey, '/', 'INST', c_custkey % 7)
      else concat('HOST', c_custkey) end as servername,
 case when c_custkey % 4 = 0 then 'Latin1_General_CI_AS' else 'SQL_Latin1_General_CP1_CI_AS' end as collation,
 concat(13 + c_custkey % 3, '.0.', c_custkey % 5000, '.0') as product_version,
 c_custkey % 10 = 0 as is_clustered
from {customer}""",
    "fx_databases": """
select o_custkey as server_id, rn as database_id, o_orderkey as db_key,
 case rn when 1 then 'master' when 2 then 'tempdb' when 3 then 'model' when 4 then 'msdb' when 5 then 'ReportServer'
      else concat(case when o_orderkey % 2 = 0 then 'DB_' else 'db_' end, o_orderkey) end as name,
 case when o_orderkey % 23 = 0 then 6 else 0 end as state,
 case when o_orderkey % 23 = 0 then 'OFFLINE' else 'ONLINE' end as state_desc,
 case when o_orderkey % 19 = 0 then null when o_orderkey % 11 = 0 then 'Latin1_General_CI_AS_KS_WS'
      when o_orderkey % 3 = 0 then 'Latin1_General_CI_AS' else 'SQL_Latin1_General_CP1_CI_AS' end as collation_name,
 case when o_orderkey % 41 = 0 then null else 130 + 10 * (o_custkey % 3) - (case when o_orderkey % 6 = 0 then 10 else 0 end) end as compatibility_level,
 o_orderkey % 29 = 0 as is_auto_close_on, o_orderkey % 31 = 0 as is_auto_shrink_on, o_orderkey % 37 <> 0 as is_arithabort_on,
 o_orderkey % 47 = 0 as is_read_only,
 1 + o_orderkey % 3 as recovery_model,
 case o_orderkey % 3 when 0 then 'FULL' when 1 then 'BULK_LOGGED' else 'SIMPLE' end as recovery_model_desc,
 o_orderkey % 80 as vlf_number,
 case when o_orderkey % 5 = 0 then concat('G', o_orderkey) end as mirroring_guid,
 case when o_orderkey % 5 = 0 then cast(floor(o_orderkey / 5) as bigint) % 5 end as mirroring_state,
 case when o_orderkey % 5 = 0 then concat('STATE_', cast(floor(o_orderkey / 5) as bigint) % 5) end as mirroring_state_desc,
 case when o_orderkey % 15 = 0 then 60 when o_orderkey % 5 = 0 then 240 end as mirroring_conn_timeout,
 case when o_orderkey % 20 = 0 then 'TCP://OTHER:5022' when o_orderkey % 5 = 0 then 'TCP://PARTNER:5022' end as mirroring_partner_name,
 case when o_orderkey % 10 = 0 then 2 when o_orderkey % 5 = 0 then 1 end as mirroring_safety_level,
 case when o_orderkey % 9 = 0 then null else o_orderdate end as last_full_backup,
 case when o_orderkey % 4 = 0 then null else o_orderdate + interval 1 day end as last_diff_backup,
 case when o_orderkey % 8 = 0 then null else o_orderdate + interval 2 day end as last_log_backup
from (select o_orderkey, o_custkey, o_orderdate, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as rn from {orders}) o""",
    "fx_files": """
select o.o_custkey as server_id, l_orderkey as db_key, l_linenumber as file_id, concat('f_', l_orderkey, '_', l_linenumber) as name,
 l_linenumber = 4 as is_percent_growth,
 case l_partkey % 4 when 0 then 0 when 1 then 12800 when 2 then 6400 else 128 end as growth_pages,
 cast(l_quantity as bigint) * 256 as size_pages
from {lineitem} join {orders} o on l_orderkey = o_orderkey""",
    "fx_error_log": """
select user_id as server_id, cast(event_id % 3 as int) as log_order, ts as log_date, concat('spid', event_id % 60) as process_info,
 case when event_id % 101 = 0 then null
  when event_id % 50 = 1 then concat('* DBCC database corruption found in DB id ', event_id % 40)
  when event_id % 50 = 2 then concat('**Stack Dump being sent to SQLDump', event_id)
  when event_id % 50 = 3 then concat('FlushCache: cleaned up ', event_id, ' bufs for db ', event_id % 40, ':0')
  when event_id % 50 = 4 then concat('SQL Server has encountered ', event_id % 9, ' occurrence(s) of I/O requests taking longer than 15 seconds to complete on file [x] in database [DB] (', event_id % 40, '). OS handle')
  when event_id % 50 = 5 then 'There were I/O requests taking longer than 15 seconds in total'
  else concat(event_type, ' message ', event_id) end as text
from {events}""",
    "fx_xe_events": """
select event_id, user_id as server_id, ts,
 case event_type when 'error' then 'xml_deadlock_report' when 'signup' then 'blocked_process_report' else 'wait_info' end as event_name,
 cast(event_id % 97 as int) as session_id, cast(floor(value * 1000) as bigint) as duration_ms,
 case event_id % 8 when 0 then 'CXPACKET' when 1 then 'BROKER_EVENTHANDLER' when 2 then 'BROKER_TRANSMITTER' when 3 then 'LCK_M_S' when 4 then 'PAGEIOLATCH_SH' when 5 then 'WRITELOG' when 6 then 'DBMIRRORING_CMD' else 'LCK_M_X' end as wait_type,
 case event_id % 40 when 0 then 1105 when 1 then 9002 when 2 then 608 else 17000 end as message_id,
 case when event_id % 60 = 7 then 21 else 16 end as severity,
 concat('app', event_id % 7) as client_app_name, concat('HOST', user_id) as client_hostname, concat('DB_', event_id % 40) as database_name,
 concat('select ', event_id) as sql_text, concat('login', user_id % 11) as username
from {events}""",
    "fx_jobs": """
select p_partkey % 50 as server_id, p_partkey as job_key,
 concat(lpad(cast(p_partkey as varchar(8)), 8, '0'), '-1A2B-3C4D-5E6F-0123456789AB') as job_id,
 case when p_partkey < 40 then 'Fleet: Check Database (User DBs)' else concat(p_name, ': ', p_brand, '/', p_partkey) end as name,
 p_size % 2 = 0 as enabled, p_size % 5 as category_id, p_size % 4 as notify_level_email,
 case when p_size % 3 = 0 then 'No description available.' else p_type end as description,
 concat('S-', p_partkey % 7) as owner_sid, 1 + p_size % 2 as start_step_id, p_size % 4 as delete_level,
 timestamp '2015-01-01 00:00:00' + interval '1' hour * cast(p_partkey % 9000 as int) as date_created,
 timestamp '2016-06-01 00:00:00' + interval '1' minute * cast(p_partkey % 9000 as int) as date_modified, 1 + p_size % 9 as version_number
from {part}""",
    "fx_job_steps": """
select p_partkey % 50 as server_id, p_partkey as job_key, 1 as step_id, concat('step ', p_type) as step_name, case when p_partkey % 2 = 0 then 'TSQL' else 'CmdExec' end as subsystem,
 concat('D:/JobLogs/', case when p_partkey % 6 = 0 then 'misc' else replace(replace(j.name, ':', '_'), '/', '_') end, '.txt') as output_file_name,
 concat('execute Fleet.maint.run ', p_partkey, repeat(' -- note', p_size * 5)) as command, 0 as cmdexec_success_code, 1 + p_size % 3 as on_success_action,
 case when p_size % 3 = 2 then 2 else 0 end as on_success_step_id, 2 as on_fail_action, 0 as on_fail_step_id, case when p_size % 4 = 0 then concat('HOST', p_partkey % 50) end as server,
 case when p_partkey % 2 = 0 then 'master' end as database_name, case when p_partkey % 8 = 0 then 'dbo' end as database_user_name, p_size % 5 as retry_attempts, p_size % 10 as retry_interval,
 case when p_partkey % 9 = 0 then p_size end as proxy_id
from {part} join {fx_jobs} j on j.job_key = p_partkey
union all
select p_partkey % 50, p_partkey, 2, concat('step ', p_brand), 'TSQL', null, concat('select ', p_partkey), 0, 1, 0, 2, 0, null, 'msdb', null, 0, 0, null from {part} where p_size % 2 = 1""",
    "fx_sessions": """
select event_id as session_id, event_id % 50 as server_id, concat('login', user_id % 11) as login_name, event_id % 4 <> 0 as is_user_process,
 case when event_id % 3 = 0 then concat('SQLAgent - TSQL JobStep (Job 0x', substr(lpad(cast(event_id % 250 as varchar(8)), 8, '0'), 7, 2), substr(lpad(cast(event_id % 250 as varchar(8)), 8, '0'), 5, 2), '00002B1A4D3C5E6F0123456789AB : Step ', 1 + event_id % 2, ')') else concat('app', event_id % 7) end as program_name from {events}""",
    "fx_requests": """
select event_id as session_id, 1 as request_id, event_id % 50 as server_id, cast(1 + event_id % 12 as int) as database_id, ts as start_time,
 ts + interval 5 minute as snap_ts, case when event_id % 13 = 0 then null else upper(event_type) end as command,
 case event_id % 6 when 0 then 'BROKER_RECEIVE_WAITFOR' when 1 then 'LCK_M_S' when 2 then null else 'CXPACKET' end as wait_type,
 concat('select ', event_id) as sql_text,
 case event_id % 5 when 0 then 'suspended' when 1 then 'running' else 'runnable' end as status,
 case event_id % 4 when 0 then 'PAGEIOLATCH_SH' when 1 then 'LCK_M_S' else 'MISCELLANEOUS' end as last_wait_type,
 cast(event_id % 9000 as int) as wait_time from {events}""",
    "fx_volumes": """
select s_suppkey as server_id, v as volume_no, concat(case v when 1 then 'C' when 2 then 'D' else 'E' end, ':/') as name, 107374182400 as capacity,
 (s_suppkey * 7919 + v * 104729) % 1000 * 107374182 as free_space from {supplier} cross join (values (1), (2), (3)) t(v)""",
    "fx_perf_samples": """
select event_id, user_id as server_id, ts, replace(case event_type when 'click' then '~Memory~Pages/sec' when 'view' then '~Processor(*)~% Processor Time'
  when 'purchase' then '~PhysicalDisk(_Total)~% Disk Time' when 'error' then '~System~Processor Queue Length'
  else '~MSSQL$X:Databases(_Total)~Transactions/sec' end, '~', chr(92)) as counter_path, value from {events}""",
    "fx_backup_files": """
select l_orderkey as db_key, o_custkey as server_id, concat('db_', l_orderkey, '_', l_linenumber, case when l_linenumber % 3 = 0 then '.trn' else '.bak' end) as file_name, l_shipdate as last_write_time, cast(floor(l_extendedprice) as bigint) as size_bytes from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "fx_registry": """
select * from (values (1,'Autogrowth not in %',1,false,true,true),(3,'DB collation = server collation',3,false,false,true),(4,'DB compat. level = server level',4,false,false,true),(6,'AutoClose off',6,false,false,true),(9,'All databases ONLINE',9,false,false,true),(13,'Instance name',13,true,false,true),(18,'Virtual log files',18,false,true,true),(27,'DB must be mirrored',27,false,false,false)) t(policy_no, policy_name, processing_order, is_server_level, online_only, is_active)""",
    "fx_exclusions": """
select * from (values (1,'master'),(3,'ReportServer'),(3,'db_1%'),(4,'DB_2_'),(18,'m[as]%'),(9,'GONE_DB')) t(policy_no, pattern)""",
    "fx_config": """
select * from (values ('pol.required_maxdop','0'),('pol.allowed_max_vlf','50'),('pol.allow_sharepoint','1'),('pol.mirr_safety_level','1'),('pol.mirr_conn_timeout','240'),('pol.mirr_partner_name','TCP://PARTNER:5022'),('maint.backup_retention_days','4'),('pol.notify_operator','Fleet-DBA'),('base.database_list','master, DB_4,DB_10')) t(name, value)""",
    "fx_operators": """
select * from (values ('Fleet-DBA','dba@example.com'),('Other','other@example.com')) t(name, email_address)""",
    "fx_module_versions": """
select * from (values ('base',1,3),('tools',1,0)) t(module_name, version_major, version_minor)""",
    "fx_module_updates": """
select * from (values ('base',1,4),('pol',1,2)) t(module_name, version_major, version_minor)""",
    "fx_categories": """
select * from (values (0,'[Uncategorized (Local)]'),(1,'Fleet'),(2,'Database Maintenance'),(3,'Report Server'),(4,'Data Collector')) t(category_id, name)""",
    "fx_options": """
select c_custkey as server_id, o as configuration_id, case o when 1517 then case when c_custkey % 14 = 0 then 1 else 0 end else c_custkey % 3 end as value_in_use from {customer} cross join (values (1517), (1539)) t(o)""",
    "fx_services": """
select c_custkey as server_id, k as kind, concat(k, '_', c_custkey % 3) as service_name, case when c_custkey % 21 = 0 then null else 2 + c_custkey % 2 end as start_mode,
 case when c_custkey % 6 = 0 then 'LocalSystem' when c_custkey % 6 = 1 then concat('svc', c_custkey, '@corp') when c_custkey % 6 = 2 then null else concat('CORP', chr(92), 'svc', c_custkey) end as account
from {customer} cross join (values ('engine'), ('agent')) t(k)""",
    "fx_logins": """
select c_custkey as server_id, n as name, c_custkey % 4 = 0 as is_disabled, c_custkey % 5 = 0 as is_expiration_checked, c_custkey % 7 = 0 as is_policy_checked from {customer} cross join (values ('sa'), ('app')) t(n)""",
    "fx_volume_bounds": """
select * from (values ('C:/',80.00,90.00),('D:/',85.00,95.00),('X:/',95.00,60.00)) t(volume_name, warning_pct, error_pct)""",
    # settings of single servers, ahead of the fleet's
    "fx_server_config": """
select c_custkey as server_id, 'pol.required_maxdop' as name, cast(c_custkey % 4 as varchar(8)) as value from {customer} where c_custkey % 3 = 0
union all select c_custkey, 'pol.allowed_max_vlf', cast(40 + c_custkey % 41 as varchar(8)) from {customer} where c_custkey % 7 = 0
union all select c_custkey, 'pol.allow_sharepoint', case when c_custkey % 10 = 0 then '0' else 'yes' end from {customer} where c_custkey % 5 = 0
union all select c_custkey, 'maint.backup_retention_days', cast(400 + c_custkey % 900 as varchar(8)) from {customer} where c_custkey % 4 = 0""",
    "fx_server_volume_bounds": """
select s_suppkey as server_id, 'c:/' as volume_name, 30.00 as warning_pct, 50.00 as error_pct from {supplier} where s_suppkey % 4 = 0
union all select s_suppkey, 'E:/', 60.00, 70.00 from {supplier} where s_suppkey % 3 = 0""",
    "fx_server_retention": """
select o_custkey as server_id, concat('db_', o_orderkey) as db_name, cast(1 + o_orderkey % 1500 as int) as retention_days from {orders} where o_orderkey % 13 = 0""",
    # an exclusion list of many names and patterns
    "fx_like_exclusions": """
select case p_partkey % 4 when 0 then 3 when 1 then 4 when 2 then 9 else 18 end as policy_no,
 case p_partkey % 9 when 0 then concat('DB[_]', p_partkey, '%') when 1 then concat('%', p_partkey) when 2 then concat('d__', p_partkey, '_')
  when 3 then concat('%[_]', p_partkey % 100, '_7%') when 4 then concat('db_', p_partkey) when 5 then concat('%5', p_partkey % 10, '%9_')
  when 6 then concat('DB[_]', p_partkey * 7) when 7 then concat('D%', p_partkey % 1000, '%') else concat('_b[_]', p_partkey, '_') end as pattern
from {part}
union all select 3, concat('DB_', o_orderkey) from {orders} where o_orderkey % 22 = 0
union all select 9, 'm%' from {part} where p_partkey = 1 union all select 18, '________' from {part} where p_partkey = 1""",
    "fx_volume_inventory": """
select concat('HOST', s_suppkey) as node, concat(case v when 1 then 'C' when 2 then 'D' when 3 then 'E' else 'F' end, ':', chr(92)) as name,
 case when (s_suppkey + v) % 3 = 0 then null else concat('Label <', s_suppkey % 10, '> & ', v) end as label,
 case when v = 4 then null else 107374182400 end as capacity, case when v = 4 then null else (s_suppkey * 7919 + v * 104729) % 1000 * 107374182 end as free_space,
 case when v = 4 then 5 when (s_suppkey + v) % 5 = 0 then 2 else 3 end as drive_type from {supplier} cross join (values (1), (2), (3), (4)) t(v)""",
    # counters inside and outside the collected set, several samples a window
    "fx_counter_samples": """
select event_id, user_id % 2 as server_id, date_trunc('day', ts) + interval '5' second * cast(event_id % 24 as int) as ts, value,
 replace(case event_id % 23 when 0 then '~Memory~Pages/sec' when 1 then '~System~Processor Queue Length' when 2 then '~Processor(0)~% Processor Time'
  when 3 then '~Processor(_Total)~% Processor Time' when 4 then '~Memory~Available MBytes' when 5 then '~Network Interface~Bytes Total/sec'
  when 6 then '~Network Interface(eth0)~Bytes Total/sec' when 7 then '~PhysicalDisk(_Total)~% Disk Time' when 8 then '~PhysicalDisk(0 C:)~% Disk Time'
  when 9 then '~physicaldisk(_total)~avg. disk queue length' when 10 then '~MSSQL$INST1:Buffer Manager~Buffer cache hit ratio' when 11 then '~SQLServer:Buffer Manager~Page life expectancy'
  when 12 then '~MSSQL$INST1:Databases(_Total)~Transactions/sec' when 13 then '~MSSQL$INST1:Databases(tempdb)~Transactions/sec' when 14 then '~SQLServer:General Statistics~User Connections'
  when 15 then '~MSSQL$INST2:Memory Manager~Total Server Memory (KB)' when 16 then '~MSSQL$INST1:SQL Statistics~Batch Requests/sec' when 17 then '~MSSQL$INST2:SQL Statistics~SQL Compilations/sec'
  when 18 then '~MSSQL$INST2:SQL Statistics~SQL Re-Compilations/sec' when 19 then '~Processor~% Processor Time' when 20 then '~Buffer Manager~Page life expectancy'
  when 21 then '~MSSQL$INST1:Memory~Pages/sec' else 'Memory~Pages/sec' end, '~', chr(92)) as counter_path from {events}""",
    # alerts that repeat within their delay; one of them holds most rows
    "fx_alert_matches": """
select event_id, case when event_id % 10 < 9 then 1 else user_id % 5 end as server_id, case when event_id % 10 < 9 then 'Fleet TX Log Full' else 'Fleet Severity 21 Errors' end as alert_name,
 timestamp '2024-01-01 00:00:00' + interval '1' second * cast((event_id * 7919) % 900000 - (event_id * 7919) % 900000 % 30 as int) as ts from {events}""",
    # requests of few servers at few moments
    "fx_activity": """
select user_id % 3 as server_id, date_trunc('day', ts) + interval '5' minute * cast(event_id % 6 as int) as snap_time_stamp,
 cast(event_id % 400 as bigint) as duration_sec from {events}""",
    # a year and more of configuration snapshots
    "fx_job_history": """
select o_orderdate + interval '1' hour * cast(o_orderkey % 24 as int) as snap_time_stamp, o_custkey as server_id, o_orderkey as job_key,
 concat('job ', o_orderpriority) as name, o_orderkey % 3 <> 0 as enabled from {orders}""",
    "fx_principals": """
select distinct p_partkey % 50 as server_id, concat('S-', p_partkey % 7) as owner_sid, concat('CORP', chr(92), 'owner', p_partkey % 7) as name
from {part} where p_partkey % 7 <> 6""",
    "fx_retention_overrides": """
select * from (values ('DB_4',10),('db_7',1),('GONE_DB',3)) t(db_name, retention_days)""",
}

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def references(name: str) -> list[str]:
    """Placeholders (tables or other views) a fixture view reads."""
    names = [field for _, field, _, _ in string.Formatter().parse(FIXTURE_SQL[name]) if field]
    return list(dict.fromkeys(names))


def closure(names) -> list[str]:
    """The views ``names`` need, dependencies first."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered or n not in FIXTURE_SQL:
            return
        for dep in references(n):
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    return ordered


def duckdb_with(names) -> str:
    """``WITH`` clause defining the fixture views ``names`` (and what they need) for DuckDB."""
    parts = []
    for n in closure(names):
        body = FIXTURE_SQL[n].format(**{r: r for r in references(n)}).strip()
        parts.append(f"{n} as ({body})")
    return "with " + ",\n".join(parts) + "\n" if parts else ""
