"""Queries over the inventory of nodes and processes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fleet
from ..session import work_folder
from .fixtures import fixture
from .registry import query

# By the beginning alone, and by the patterns first: a payment subject is a nim whatever else it names.
SQL_BY_PREFIX = """case when starts_with(subject, 'river.') then 'tree'
      when starts_with(subject, 'contact.') or starts_with(subject, 'lead.scored') or subject like '%treehouse%' then 'treehouse' else 'nim' end"""
SQL_KIND = f"case when starts_with(subject, 'payment.') then 'nim' else {SQL_BY_PREFIX} end"
SQL_PROCESSES = f"""
  seen as (select * from fx_subscriptions where subject <> '' and not regexp_matches(subject, '^[_$]')),
  procs as (select sub_id, coalesce(n.node_id, (select min(node_id) from fx_nodes)) as node_id, {SQL_KIND} as kind, s.ram_allocated
    from seen s left join fx_nodes n on s.node_id = n.node_id)
"""


def nodes(spark, folder) -> DataFrame:
    return fixture(spark, folder, "fx_nodes").drop("s_suppkey")


def processes(spark, folder) -> DataFrame:
    """Visible subscriptions as processes with their own memory, attached to existing nodes."""
    subs = fixture(spark, folder, "fx_subscriptions").where(fleet.visible(F.col("subject")))
    rows = subs.withColumn("kind", fleet.process_kind(F.col("subject"))).withColumnRenamed("sub_id", "process_id")
    return fleet.attach(rows, nodes(spark, folder))


@query(
    "node_capability",
    "fx_nodes",
    sql="""
    select node_id, case when gpu_vram > 0 and has_docker then 'manaland' when has_docker then 'nimland' else 'land' end as class,
      has_docker as can_agents, gpu_vram > 0 and has_docker as can_gpu
    from fx_nodes""",
)
def node_capability(spark, folder):
    vram, docker = F.col("gpu_vram"), F.col("has_docker")
    return nodes(spark, folder).select(
        "node_id",
        fleet.node_class(vram, docker).alias("class"),
        fleet.can_run_agents(docker).alias("can_agents"),
        fleet.can_run_gpu(vram, docker).alias("can_gpu"),
    )


@query("classify_process", "fx_subscriptions", sql=f"select sub_id, {SQL_KIND} as kind, {SQL_BY_PREFIX} as by_prefix from fx_subscriptions")
def classify_process(spark, folder):
    subject = F.upper("subject")
    return fixture(spark, folder, "fx_subscriptions").select(
        "sub_id", fleet.process_kind(subject).alias("kind"), fleet.kind_by_prefix(subject).alias("by_prefix")
    )


@query(
    "process_name",
    "fx_subscriptions",
    sql="""
    select sub_id, case subject when 'river.stripe.webhook' then 'stripe-webhook' when 'river.general.>' then 'general'
      when 'payment.>' then 'payment' when 'misc.*' then 'misc' else replace(subject, '.', '-') end as name
    from fx_subscriptions""",
)
def process_name(spark, folder):
    return fixture(spark, folder, "fx_subscriptions").select("sub_id", fleet.process_name(F.col("subject")).alias("name"))


@query(
    "drop_internal_subjects",
    "fx_subscriptions",
    sql="select sub_id, subject from fx_subscriptions where subject <> '' and left(subject, 1) not in ('_', '$')",
)
def drop_internal_subjects(spark, folder):
    return fixture(spark, folder, "fx_subscriptions").where(fleet.visible(F.col("subject"))).select("sub_id", "subject")


SQL_NAME = "coalesce(nullif(replace(regexp_replace(regexp_replace(subject, '^river[.]', ''), '[.][>*]$', ''), '.', '-'), ''), 'unknown')"


@query(
    "process_dedupe",
    "fx_subscriptions",
    "fx_consumer_rows",
    "fx_connections",
    sql=f"""
    subs as (select 'subscription' as origin, queue as owner, subject, count(*) as n_subjects, {SQL_NAME} as name
      from fx_subscriptions where not regexp_matches(subject, '^[_$]') group by queue, subject),
    cons as (select 'consumer', stream_name, min(filter_subject) as subject, 1, name as given
      from fx_consumer_rows where filter_subject <> '' group by stream_name, name),
    conns as (select distinct 'connection', name, subject, 1, {SQL_NAME} from fx_connections where contains(name, 'eventflow') and not regexp_matches(subject, '^[_$]')),
    every_one as (select * from subs union all select * replace (case when given = '' then {SQL_NAME} else given end as given) from cons union all select * from conns)
    select origin, owner, subject, n_subjects, {SQL_KIND} as kind, {SQL_KIND}||'-'||name as process_id, cast(268435456 as bigint) as ram_allocated from every_one""",
)
def process_dedupe(spark, folder):
    """Processes of subscriptions, of consumers and of the service's own connections."""
    found = {
        "subscription": (fleet.detect_processes(fixture(spark, folder, "fx_subscriptions")), "queue"),
        "consumer": (fleet.detect_consumers(fixture(spark, folder, "fx_consumer_rows")).withColumnRenamed("filter_subject", "subject"), "stream_name"),
        "connection": (fleet.detect_connections(fixture(spark, folder, "fx_connections"), "eventflow"), "connection"),
    }
    parts = [
        rows.select(F.lit(origin).alias("origin"), F.col(owner).alias("owner"), "subject", "n_subjects", "kind", "process_id", "ram_allocated")
        for origin, (rows, owner) in found.items()
    ]
    return fleet.union_processes(*parts)


@query(
    "attach_process",
    "fx_subscriptions",
    "fx_nodes",
    sql=SQL_PROCESSES + "select sub_id as process_id, node_id, kind from procs",
)
def attach_process(spark, folder):
    return processes(spark, folder).select("process_id", "node_id", "kind")


@query(
    "fleet_node_usage",
    "fx_subscriptions",
    "fx_nodes",
    sql=SQL_PROCESSES
    + """, used as (select node_id, sum(ram_allocated) as ram, count(*) as c from procs group by node_id)
    select n.node_id, ram_total, cast(coalesce(ram, 0) as bigint) as ram_allocated, cast(greatest(ram_total - coalesce(ram, 0), 0) as bigint) as ram_available,
      coalesce(ram, 0)::double / ram_total::double * 100 as occupancy, coalesce(c, 0) as process_count
    from fx_nodes n left join used u on n.node_id = u.node_id""",
)
def fleet_node_usage(spark, folder):
    rows = fleet.node_usage(nodes(spark, folder), processes(spark, folder))
    return rows.select("node_id", "ram_total", "ram_allocated", "ram_available", "occupancy", "process_count")


@query(
    "fleet_summary",
    "fx_subscriptions",
    "fx_nodes",
    sql=SQL_PROCESSES
    + """, n as (select cast(count(*) filter (gpu_vram = 0) as bigint) as regular_nodes, cast(count(*) filter (gpu_vram > 0) as bigint) as gpu_nodes,
        cast(sum(ram_total) as bigint) as total_ram, cast(sum(cpu_cores) as bigint) as total_cores, cast(sum(gpu_vram) as bigint) as total_vram from fx_nodes),
    p as (select cast(count(*) filter (kind = 'tree') as bigint) as tree_count, cast(sum(ram_allocated) filter (kind = 'tree') as bigint) as tree_ram,
        cast(count(*) filter (kind = 'treehouse') as bigint) as treehouse_count, cast(sum(ram_allocated) filter (kind = 'treehouse') as bigint) as treehouse_ram,
        cast(count(*) filter (kind = 'nim') as bigint) as nim_count, cast(sum(ram_allocated) filter (kind = 'nim') as bigint) as nim_ram,
        cast(sum(ram_allocated) as bigint) as total_allocated from procs)
    select n.*, p.*, total_allocated::double / total_ram::double * 100 as occupancy from n, p""",
)
def fleet_summary(spark, folder):
    return fleet.summary(nodes(spark, folder), processes(spark, folder))


@query(
    "fleet_capacity_by_class",
    "fx_nodes",
    sql="""
    select case when gpu_vram > 0 then 'gpu' else 'regular' end as class, count(*) as nodes, cast(sum(ram_total) as bigint) as ram,
      cast(sum(cpu_cores) as bigint) as cores, cast(sum(gpu_vram) as bigint) as vram from fx_nodes group by 1
    union all select 'total', count(*), cast(sum(ram_total) as bigint), cast(sum(cpu_cores) as bigint), cast(sum(gpu_vram) as bigint) from fx_nodes""",
)
def fleet_capacity_by_class(spark, folder):
    return fleet.capacity_by_class(nodes(spark, folder))


@query(
    "fleet_snapshot",
    "fx_subscriptions",
    "fx_nodes",
    sql=SQL_PROCESSES
    + """select 'nodes' as section, node_id as id, ram_total as ram, hostname as detail from fx_nodes
    union all select kind||'s', cast(sub_id as varchar), ram_allocated, node_id from procs
    union all select 'summary', '', (select cast(sum(ram_total) as bigint) from fx_nodes),
      cast(count(*) filter (kind = 'tree') as varchar)||' trees, '||cast(sum(ram_allocated) as varchar) from procs""",
)
def fleet_snapshot(spark, folder):
    rows = fleet.snapshot(nodes(spark, folder), processes(spark, folder))
    part = lambda path: F.get_json_object("body", path)
    totals = F.concat(part("$.tree_count"), F.lit(" trees, "), part("$.total_allocated"))
    return rows.select("section", "id", "ram", F.coalesce(part("$.hostname"), part("$.node_id"), totals).alias("detail"))


@query(
    "fleet_snapshot_changes",
    "fx_subscriptions",
    "fx_nodes",
    sql=SQL_PROCESSES
    + """, moved as (select kind||'s' as section, cast(sub_id as varchar) as id, ram_allocated as ram,
        case when sub_id % 13 = 0 then 'added' when sub_id % 19 = 0 then 'removed' when sub_id % 17 = 0 then 'changed' end as change from procs)
    select change, section, id, ram from moved where change is not null
    union all select 'changed', 'nodes', node_id, ram_total from fx_nodes where s_suppkey % 9 = 0
    union all select 'changed', 'summary', '', cast(sum(ram_total) as bigint) from fx_nodes""",
)
def fleet_snapshot_changes(spark, folder):
    """Two published versions of the inventory: nodes renamed, processes added, removed and grown."""
    base, key = work_folder(spark, "inventory"), F.col("process_id")
    new_nodes, rows = nodes(spark, folder), processes(spark, folder)
    renamed = F.when(F.substring_index("node_id", "-", -1).cast("int") % 9 == 0, F.concat("hostname", F.lit("-old")))
    old_nodes = new_nodes.withColumn("hostname", F.coalesce(renamed, F.col("hostname")))
    ram = F.when((key % 17 == 0) & (key % 19 != 0), F.col("ram_allocated") + 1).otherwise(F.col("ram_allocated"))
    old_rows = rows.where(key % 13 != 0).withColumn("ram_allocated", ram)
    new_rows = rows.where((key % 19 != 0) | (key % 13 == 0))
    fleet.publish(fleet.snapshot(old_nodes, old_rows), base, 1, buckets=8)
    fleet.publish(fleet.snapshot(new_nodes, new_rows), base, 2, buckets=8)
    return fleet.published_changes(spark, base, 1, 2).select("change", "section", "id", "ram")


@query("fleet_nodes_sorted", "fx_nodes", sql="select node_id, hostname from fx_nodes order by node_id")
def fleet_nodes_sorted(spark, folder):
    return nodes(spark, folder).select("node_id", "hostname").orderBy("node_id")


@query("first_node", "fx_nodes", sql="select min(node_id) as node_id from fx_nodes")
def first_node(spark, folder):
    return nodes(spark, folder).agg(F.min("node_id").alias("node_id"))


@query(
    "subscriptions_limited",
    "fx_subscriptions",
    sql="select sub_id, subject from fx_subscriptions order by subject, sub_id limit 1000",
)
def subscriptions_limited(spark, folder):
    return fleet.listing(fixture(spark, folder, "fx_subscriptions")).select("sub_id", "subject")


@query(
    "union_nodes",
    "fx_nodes",
    sql="""
    select node_id, case when s_suppkey % 3 = 0 then upper(hostname) else hostname end as hostname, ram_total from fx_nodes
    union all select 'peer-'||s_suppkey, hostname, ram_total from fx_nodes where s_suppkey % 3 = 1""",
)
def union_nodes(spark, folder):
    """Peers repeat every third node with a newer name, and bring nodes of their own."""
    rows = fixture(spark, folder, "fx_nodes")
    key = F.col("s_suppkey")
    local = rows.select("node_id", "hostname", "ram_total", F.lit(1).alias("seen"))
    again = rows.where(key % 3 == 0).select("node_id", F.upper("hostname").alias("hostname"), "ram_total", F.lit(2).alias("seen"))
    own = rows.where(key % 3 == 1).select(
        F.concat(F.lit("peer-"), key.cast("string")).alias("node_id"), "hostname", "ram_total", F.lit(2).alias("seen")
    )
    return fleet.union_nodes(local, again.unionByName(own)).select("node_id", "hostname", "ram_total")


@query(
    "union_processes",
    "fx_subscriptions",
    "fx_nodes",
    sql=SQL_PROCESSES
    + """select sub_id as process_id, kind, case when kind <> 'treehouse' then 1 else 0 end as has_subject,
      case when kind = 'treehouse' then 'scripts/'||sub_id else '' end as script from procs""",
)
def union_processes(spark, folder):
    """The three kinds carry different columns: subjects, a script path, a model flag."""
    rows = processes(spark, folder)
    trees = rows.where("kind = 'tree'").select("process_id", "kind", "subject")
    houses = rows.where("kind = 'treehouse'").select(
        "process_id", "kind", F.concat(F.lit("scripts/"), F.col("process_id").cast("string")).alias("script")
    )
    nims = rows.where("kind = 'nim'").select("process_id", "kind", "subject", F.lit(True).alias("ai_enabled"))
    both = fleet.union_processes(trees, houses, nims)
    return both.select(
        "process_id", "kind", F.col("subject").isNotNull().cast("int").alias("has_subject"), F.coalesce("script", F.lit("")).alias("script")
    )


# --- change folding -----------------------------------------------------------------------


# Which copy a removal without a node ends depends on what earlier ones took, so the SQL recurses.
SQL_TARGETS = """
  node_ev as (select node_id, slot, type from fx_fleet_events where type in ('land_added','land_removed')),
  placed as (select e.*, n.slot as n_slot, n.type as n_type from fx_fleet_events e asof left join node_ev n on e.node_id = n.node_id and e.slot > n.slot),
  adds as (select node_id, process_id, slot from placed where type = 'process_added' and n_type = 'land_added'),
  open_rem as (select slot, process_id, row_number() over (partition by process_id order by slot) as k
    from fx_fleet_events where type = 'process_removed' and node_id is null),
  last_add as (select o.process_id, o.slot, o.k, a.node_id, max(a.slot) as add_slot
    from open_rem o join adds a on o.process_id = a.process_id and a.slot < o.slot group by all),
  cand as (select process_id, slot, list(struct_pack(node := node_id, since := add_slot) order by node_id) as copies from last_add l
    where not exists (select 1 from node_ev n where n.node_id = l.node_id and n.slot > l.add_slot and n.slot < l.slot)
      and not exists (select 1 from fx_fleet_events r where r.type = 'process_removed' and r.node_id = l.node_id and r.process_id = l.process_id
        and r.slot > l.add_slot and r.slot < l.slot) group by process_id, slot),
  step as (select o.process_id, o.slot, o.k, coalesce(c.copies, []) as copies from open_rem o left join cand c on o.process_id = c.process_id and o.slot = c.slot),
  hit as (with recursive h as (
      select process_id, cast(0 as bigint) as k, cast(null as bigint) as slot, cast(null as varchar) as node, cast([] as struct(node varchar, since bigint)[]) as taken
      from (select distinct process_id from open_rem)
      union all
      select process_id, k, slot, node, case when node is null then taken else list_append(taken, struct_pack(node := node, since := slot)) end
      from (select s.process_id, s.k, s.slot, h.taken,
          list_filter(s.copies, lambda c: len(list_filter(h.taken, lambda x: x.node = c.node and x.since > c.since)) = 0)[1].node as node
        from h join step s on s.process_id = h.process_id and s.k = h.k + 1))
    select slot, node from h where k > 0),
  changes as (select e.slot, e.type, e.process_id, e.ram, e.node_id, coalesce(e.node_id, hit.node) as target from fx_fleet_events e left join hit on e.slot = hit.slot)
"""


@query(
    "fleet_apply_events",
    "fx_fleet_events",
    sql=SQL_TARGETS
    + """,
    n as (select node_id, max(slot) filter (type = 'land_added') as a, max(slot) filter (type = 'land_removed') as r,
        max_by(ram, slot) filter (type in ('land_added','land_updated')) as ram from fx_fleet_events group by node_id),
    live as (select * from n where a > coalesce(r, 0)),
    p as (select target as node_id, process_id, max(slot) filter (type = 'process_added') as a, max(slot) filter (type = 'process_removed') as r,
        max_by(ram, slot) filter (type = 'process_added') as ram from changes group by target, process_id),
    u as (select process_id, max(slot) as s, max_by(ram, slot) as ram from fx_fleet_events where type = 'process_updated' group by process_id)
    select 'node' as kind, node_id, '' as process_id, ram from live
    union all select 'process', p.node_id, p.process_id, case when u.s > p.a then u.ram else p.ram end
    from p join live on p.node_id = live.node_id left join u on p.process_id = u.process_id
    where p.a > live.a and p.a > coalesce(p.r, 0)""",
)
def fleet_apply_events(spark, folder):
    changes = fixture(spark, folder, "fx_fleet_events")
    node_rows = fleet.live_nodes(changes).select(
        F.lit("node").alias("kind"), "node_id", F.lit("").alias("process_id"), "ram"
    )
    process_rows = fleet.live_processes(changes).select(F.lit("process").alias("kind"), "node_id", "process_id", "ram")
    return node_rows.unionByName(process_rows)


SQL_FEED = (
    SQL_TARGETS
    + """,
  a as (select e.*, n.slot as n_slot, n.type as n_type from changes e asof left join node_ev n on e.target = n.node_id and e.slot > n.slot),
  every_add as (select node_id, process_id, slot from fx_fleet_events where type = 'process_added'),
  rems as (select target, process_id, slot from changes where type = 'process_removed' and target is not null),
  b as (select a.*, x.slot as add_slot from a asof left join every_add x on a.target = x.node_id and a.process_id = x.process_id and a.slot > x.slot),
  c as (select b.*, rems.slot as rem_slot from b asof left join rems on b.target = rems.target and b.process_id = rems.process_id and b.slot > rems.slot),
  stays as (select c.process_id, c.slot as s, least(coalesce((select min(x.slot) from node_ev x where x.node_id = c.target and x.slot > c.slot), 1152921504606846976),
      coalesce((select min(y.slot) from rems y where y.target = c.target and y.process_id = c.process_id and y.slot > c.slot), 1152921504606846976)) as e
    from c where type = 'process_added' and n_type = 'land_added'),
  reached as (select distinct c.slot from c join stays on c.process_id = stays.process_id and c.slot > stays.s and c.slot < stays.e where c.type = 'process_updated'),
  done as (select *, case type when 'land_added' then true when 'land_removed' then coalesce(n_type = 'land_added', false)
      when 'land_updated' then coalesce(n_type = 'land_added', false) when 'process_added' then coalesce(n_type = 'land_added', false)
      when 'process_removed' then coalesce(n_type = 'land_added' and add_slot > n_slot and add_slot > coalesce(rem_slot, 0), false)
      else slot in (select slot from reached) end as applied from c)
"""
)


@query("fleet_event_feed", "fx_fleet_events", sql=SQL_FEED + "select slot, type, node_id, process_id from done where applied")
def fleet_event_feed(spark, folder):
    return fleet.event_feed(fixture(spark, folder, "fx_fleet_events")).select("slot", "type", "node_id", "process_id")


@query(
    "retain_recent_events",
    "fx_fleet_events",
    sql=SQL_FEED + "select slot, type from done where applied order by slot desc limit 100",
)
def retain_recent_events(spark, folder):
    """The newest hundred changes that took effect."""
    return fleet.recent(fleet.event_feed(fixture(spark, folder, "fx_fleet_events"))).select("slot", "type")
