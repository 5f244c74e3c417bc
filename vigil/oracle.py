"""DuckDB twins of the registered queries (the correctness gate).

Written independently of the DataFrame code: plain SQL over the same fixture
views (``sources.fixtures`` supplies the view text).  Only fixed data -- the
built-in registry and exclusion seeds -- is shared, as VALUES lists.
"""

from __future__ import annotations

from vigil.operators.registry import MAINT_DB, default_policies
from vigil.sources.fixtures import duckdb_with

AS_OF = "1998-08-02 00:00:00"
TS = "'%Y-%m-%d %H:%M:%S'"

_ENGINE_OR_AGENT = "case when v.kind = 'engine' then 'SQL Server (' else 'SQL Server Agent (' end"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def registry_values() -> str:
    rows = ",".join(f"({p.number},{_q(p.name)},{p.number},{str(p.server_level).lower()},"
                    f"{str(p.online_only).lower()},{str(p.active).lower()})" for p in default_policies())
    return (f"select * from (values {rows}) t(policy_no, policy_name, processing_order, is_server_level, "
            f"online_only, is_active)")


def exclusion_values() -> str:
    rows = []
    for p in default_policies():
        if p.exclusions is not None:
            for item in dict.fromkeys(x.strip() for x in p.exclusions.split(",")):
                rows.append(f"({p.number},{_q(item)})")
    return f"select * from (values {','.join(rows)}) t(policy_no, pattern)"


CFG = """select
 try_cast(max(case when name = 'pol.allow_sharepoint' then value end) as integer) as allow_sp,
 try_cast(max(case when name = 'pol.allowed_max_vlf' then value end) as integer) as max_vlf,
 try_cast(max(case when name = 'pol.required_maxdop' then value end) as integer) as maxdop,
 try_cast(max(case when name = 'pol.mirr_safety_level' then value end) as integer) as m_safety,
 try_cast(max(case when name = 'pol.mirr_conn_timeout' then value end) as integer) as m_timeout,
 max(case when name = 'pol.mirr_partner_name' then value end) as m_partner
from fx_config"""

# columns: server_id, policy_no, db_level, db_name, db_state, stmt_no, log_order, log_date, message
_DB = "d.server_id, {p} as policy_no, true as db_level, d.name as db_name, d.state as db_state, {s} as stmt_no, " \
      "cast(null as integer) as log_order, cast(null as timestamp) as log_date, "
_SRV = "{a}.server_id, {p} as policy_no, false as db_level, {db} as db_name, cast(null as integer) as db_state, " \
       "{s} as stmt_no, cast(null as integer) as log_order, cast(null as timestamp) as log_date, "


def _db(p, s=1):
    return _DB.format(p=p, s=s)


def _srv(p, s=1, a="s", db="cast(null as varchar)"):
    return _SRV.format(p=p, s=s, a=a, db=db)


def _old(c):
    return f"({c} is null or (cast(timestamp '{AS_OF}' as date) - cast({c} as date)) > 2)"


def _shown(c):
    return f"coalesce(strftime({c}, {TS}), '?')"


POLICY_SQL: dict[int, str] = {
    1: f"""select {_db(1)} 'File: ' || f.name as message
from fx_files f join fx_databases d on d.server_id = f.server_id and d.db_key = f.db_key
where f.is_percent_growth""",
    2: f"""select {_db(2)} 'File: ' || f.name as message
from fx_files f join fx_databases d on d.server_id = f.server_id and d.db_key = f.db_key
where f.growth_pages <> 0 and f.growth_pages <> 12800 and not f.is_percent_growth""",
    3: f"""select {_db(3)} case when c.allow_sp is null then 'pol.allow_sharepoint is not set.'
  else 'DB: ' || coalesce(d.collation_name, '?') || '; Server: ' || s.collation end as message
from fx_databases d left join fx_servers s on s.server_id = d.server_id cross join cfg c
where c.allow_sp is null or d.collation_name is null
   or (d.collation_name <> s.collation and ((case when c.allow_sp = 1 then 1 else 0 end) = 0
       or d.collation_name <> 'Latin1_General_CI_AS_KS_WS'))""",
    4: f"""select {_db(4)} 'DB: ' || coalesce(cast(d.compatibility_level as varchar), '?') || '; Server: '
  || split_part(s.product_version, '.', 1) || '0' as message
from fx_databases d left join fx_servers s on s.server_id = d.server_id
where d.compatibility_level is null
   or cast(d.compatibility_level as varchar) <> split_part(s.product_version, '.', 1) || '0'""",
    5: f"""select {_db(5, 1)} 'Last Full Backup: ' || {_shown('d.last_full_backup')} || ', Last Diff. Backup: '
  || {_shown('d.last_diff_backup')} as message
from fx_databases d where {_old('d.last_full_backup')} and {_old('d.last_diff_backup')}
union all
select {_db(5, 2)} 'Last Log Backup: ' || {_shown('d.last_log_backup')} as message
from fx_databases d where {_old('d.last_log_backup')} and lower(d.recovery_model_desc) <> 'simple'
  and lower(d.name) <> 'model'""",
    6: f"select {_db(6)} 'AutoClose=ON' as message from fx_databases d where d.is_auto_close_on",
    7: f"select {_db(7)} 'AutoShrink=ON' as message from fx_databases d where d.is_auto_shrink_on",
    8: f"select {_db(8)} d.recovery_model_desc as message from fx_databases d where d.recovery_model = 3",
    9: f"select {_db(9)} d.state_desc as message from fx_databases d where d.state <> 0",
    10: f"""select {_srv(10, "case when v.kind = 'engine' then 1 else 2 end", a='v')}
  {_ENGINE_OR_AGENT} || v.service_name || ') must be configured to start '
  || case when coalesce(s.is_clustered, false) then 'manually' else 'automatically' end || '.' as message
from fx_services v left join fx_servers s on s.server_id = v.server_id
where v.kind in ('engine', 'agent') and v.start_mode <> case when coalesce(s.is_clustered, false) then 3 else 2 end""",
    11: f"""select {_srv(11, "case when v.kind = 'engine' then 1 else 2 end", a='v')}
  {_ENGINE_OR_AGENT} || v.service_name || ') must run under named account. Currently runs under '
  || v.account || '.' as message
from fx_services v
where v.kind in ('engine', 'agent') and strpos(v.account, chr(92)) = 0 and strpos(v.account, '@') = 0""",
    12: f"""select {_srv(12, a='o')} 'The option "priority boost" must be turned off.' as message
from fx_options o where o.configuration_id = 1517 and o.value_in_use = 1""",
    13: f"""select * from (select {_srv(13)} case when s.servername is null then '@@servername may not be null.'
  when not starts_with(lower(s.servername), lower(s.machine_name || '/')) and lower(s.servername) <> lower(s.machine_name)
  then 'Invalid instance name. Machine: ' || s.machine_name || ', but instance: ' || s.servername || '.' end as message
from fx_servers s) x where message is not null""",
    14: f"""select * from (select {_srv(14)} case when j.any_enabled is null then 'Job for check of user databases does not exist.'
  when not j.any_enabled then 'Job for check of user databases is disabled.' end as message
from fx_servers s left join (select server_id, bool_or(enabled) as any_enabled from fx_jobs
  where lower(name) = lower('{MAINT_DB}: Check Database (User DBs)') group by server_id) j on j.server_id = s.server_id) x
where message is not null""",
    16: f"""select * from (select {_srv(16)} case when c.maxdop is null then 'pol.required_maxdop is not set.'
  when c.maxdop <> o.value_in_use then 'Must be set to ' || c.maxdop || ', but currently is ' || o.value_in_use || '.' end as message
from fx_servers s left join (select server_id, value_in_use from fx_options where configuration_id = 1539) o
  on o.server_id = s.server_id cross join cfg c) x where message is not null""",
    17: f"""select {_srv(17, 1, a='l')} 'SA account is disabled.' as message from fx_logins l where lower(l.name) = 'sa' and l.is_disabled
union all select {_srv(17, 2, a='l')} 'Expiration for SA account is set.' from fx_logins l where lower(l.name) = 'sa' and l.is_expiration_checked
union all select {_srv(17, 3, a='l')} 'Policy check for SA account is set.' from fx_logins l where lower(l.name) = 'sa' and l.is_policy_checked""",
    18: f"""select {_db(18)} case when c.max_vlf is null then 'pol.allowed_max_vlf is not set.'
  else 'Max. allowed: ' || c.max_vlf || ', but currently: ' || d.vlf_number || '.' end as message
from fx_databases d cross join cfg c where c.max_vlf is null or d.vlf_number > c.max_vlf""",
    19: f"""select {_srv(19, 1, db='p.pattern')} 'The database cannot be found, but an entry exists in base.tblProcessingExclusion. Please check.' as message
from fx_servers s cross join (select distinct pattern from excl where lower(pattern) not in ('reportserver', 'reportservertempdb')
  and strpos(pattern, '%') = 0 and strpos(pattern, '[') = 0 and strpos(pattern, ']') = 0) p
where not exists (select 1 from fx_databases d where d.server_id = s.server_id and d.name ilike p.pattern)
union all
select {_srv(19, 2, db='o.db_name')} 'The database cannot be found, but an entry exists in base.tblIndividualBackupSetting. Please check.'
from fx_servers s cross join (select distinct db_name from fx_retention_overrides) o
where not exists (select 1 from fx_databases d where d.server_id = s.server_id and lower(d.name) = lower(o.db_name))""",
    20: f"""select {_srv(20, a='d', db='e.pattern')} 'This exclusion for policy 3 is not needed, since the database has SharePoint collation and pol.allow_sharepoint=1.' as message
from fx_databases d join excl e on e.policy_no = 3 and lower(d.name) = lower(e.pattern) cross join cfg c
where d.collation_name = 'Latin1_General_CI_AS_KS_WS' and lower(e.pattern) not in ('reportserver', 'reportservertempdb')
  and coalesce(c.allow_sp, 0) = 1""",
    21: """select l.server_id, 21 as policy_no, false as db_level, cast(null as varchar) as db_name,
  cast(null as integer) as db_state, 1 as stmt_no,
  l.log_order, l.log_date, left(strftime(l.log_date, '%Y-%m-%d %H:%M:%S') || ' ' || ltrim(replace(l.text, '*', '')), 250) as message
from fx_error_log l where l.log_order in (0, 1) and l.text is not null
  and (l.text ilike '%DBCC database corruption%' or l.text ilike '%Stack Dump%SQLDump%')""",
    22: f"""select {_srv(22, a='n')} n.n || ' job step log name(s) do not conform to naming rules.' as message
from (select st.server_id, count(*) as n from fx_job_steps st join fx_jobs j on j.server_id = st.server_id and j.job_key = st.job_key
  where st.output_file_name is not null
    and lower(regexp_replace(regexp_extract(st.output_file_name, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''))
        <> lower(translate(j.name, '.\\/:*?<>|', '_________'))
  group by st.server_id) n where n.n > 0""",
    23: f"""select {_srv(23, a='j')} 'Job "' || j.name || '": Category "' || c.name || '"' as message
from fx_jobs j join fx_categories c on c.category_id = j.category_id where starts_with(lower(c.name), '[uncategorized')""",
    24: f"""select {_srv(24, a='j')} 'Job "' || j.name || '": mail notification must be "on failure" or "on completion".' as message
from fx_jobs j where j.notify_level_email not in (2, 3)""",
    25: """select p.server_id, 25 as policy_no, false as db_level, coalesce(d.name, '???') as db_name,
  cast(null as integer) as db_state,
  1 as stmt_no, p.log_order, p.log_date, p.message
from (select server_id, log_order, log_date, left(strftime(log_date, '%Y-%m-%d %H:%M:%S') || ' ' || text, 250) as message,
  try_cast(trim(case when text ilike '% for db %:%'
      then split_part(substr(text, strpos(lower(text), ' for db ') + 8), ':', 1)
    when text ilike '% in database [%] (%). %'
      then split_part(split_part(substr(text, strpos(lower(text), ' in database [') + 14), '(', 2), ')', 1)
    else '0' end) as integer) as db_id
  from fx_error_log where log_order in (0, 1) and text is not null
    and (text ilike 'FlushCache: % for db %:%' or text ilike '% I/O requests taking longer than 15 seconds %')) p
left join fx_databases d on d.server_id = p.server_id and d.database_id = p.db_id""",
    26: f"select {_db(26)} 'ARITHABORT=OFF' as message from fx_databases d where d.is_arithabort_on = false",
    27: f"""select {_db(27)} 'It seems that mirroring is not configured for this DB. Please check.' as message
from fx_databases d where d.mirroring_guid is null""",
    28: f"""select {_db(28)} d.mirroring_state_desc as message from fx_databases d
where d.mirroring_guid is not null and d.mirroring_state not in (2, 4)""",
    29: f"""select {_db(29, 1)} 'pol.mirr_safety_level is not set.' as message from fx_databases d cross join cfg c where c.m_safety is null
union all select {_db(29, 2)} 'pol.mirr_conn_timeout is not set.' from fx_databases d cross join cfg c where c.m_timeout is null
union all select {_db(29, 3)} 'pol.mirr_partner_name is not set.' from fx_databases d cross join cfg c where c.m_partner is null
union all select {_db(29, 4)} 'Safety level: is=' || d.mirroring_safety_level || ', must be=' || c.m_safety || '.'
  from fx_databases d cross join cfg c where c.m_safety is not null and c.m_timeout is not null and c.m_partner is not null
  and d.mirroring_guid is not null and d.mirroring_safety_level <> c.m_safety
union all select {_db(29, 5)} 'Connection timeout: is=' || d.mirroring_conn_timeout || ', must be=' || c.m_timeout || '.'
  from fx_databases d cross join cfg c where c.m_safety is not null and c.m_timeout is not null and c.m_partner is not null
  and d.mirroring_guid is not null and d.mirroring_conn_timeout <> c.m_timeout
union all select {_db(29, 6)} 'Partner name: is=' || d.mirroring_partner_name || ', must be=' || c.m_partner || '.'
  from fx_databases d cross join cfg c where c.m_safety is not null and c.m_timeout is not null and c.m_partner is not null
  and d.mirroring_guid is not null and lower(d.mirroring_partner_name) <> lower(c.m_partner)""",
}

POLICY_VIEWS = ["fx_servers", "fx_databases", "fx_files", "fx_error_log", "fx_jobs", "fx_job_steps",
                "fx_categories", "fx_options", "fx_services", "fx_logins", "fx_config", "fx_retention_overrides"]


def _policy_ctes(numbers, extra_views=()) -> str:
    body = "\nunion all\n".join(f"select * from ({POLICY_SQL[n]}) p{n}" for n in numbers)
    return (duckdb_with(POLICY_VIEWS + list(extra_views))
            + f", cfg as ({CFG}),\nregistry as ({registry_values()}),\nexcl as ({exclusion_values()}),\n"
            + f"v as ({body}),\n"
            + """elig as (select v.* replace (coalesce(v.message, '?') as message), r.policy_name, r.processing_order, r.is_active
  from v join registry r on r.policy_no = v.policy_no where (not v.db_level or not r.online_only or v.db_state = 0)
    and not (v.db_level and exists (select 1 from excl x where x.policy_no = v.policy_no
      and regexp_full_match(v.db_name, '(?is)' || replace(replace(x.pattern, '%', '.*'), '_', '.')))))
""")


def policy_sql(n: int) -> str:
    return _policy_ctes([n]) + "select server_id, policy_no, db_name, stmt_no, message from elig"


def report_sql() -> str:
    nums = sorted(POLICY_SQL)
    return _policy_ctes(nums) + """select server_id,
  row_number() over (partition by server_id order by processing_order, policy_no,
    case when db_level then lower(db_name) end nulls first, case when db_level then db_name end nulls first,
    stmt_no, log_order desc nulls last, log_date nulls first, db_name nulls first, message) as seq,
  policy_no, policy_name, db_name, message
from elig where is_active"""
