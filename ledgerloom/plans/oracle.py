"""The registered queries in DuckDB's SQL, over the driver's tables."""

from __future__ import annotations

BASE = """
with recursive h as (select o_orderdate, (row_number() over (order by o_orderdate) - 1)::bigint as block_height from (select distinct o_orderdate from orders)),
tx as (select o_orderkey, o_custkey, 'tx' || lpad(o_orderkey::varchar, 12, '0') as txid, block_height, sha256('b' || block_height) as block_hash, epoch(o.o_orderdate)::bigint as block_time,
  (row_number() over (partition by o.o_orderdate order by o_orderkey) - 1)::bigint as tx_index, lead(o_orderkey) over (partition by o_custkey order by o.o_orderdate, o_orderkey) as next_key
  from orders o join h on h.o_orderdate = o.o_orderdate),
creates_log as (select txid || ':' || (l_linenumber - 1) as output_key, txid, tx_index, (l_linenumber - 1)::bigint as vout, block_height, block_hash, block_time,
  case when l_returnflag = 'N' and l_linestatus = 'O' then '' else 'S' || l_suppkey end as address, round(l_extendedprice * 100)::bigint as value_base, not (l_returnflag = 'N' and l_linestatus = 'O') as is_spendable,
  datediff('day', date '1970-01-01', l_shipdate::date)::bigint as version, l_partkey, l_suppkey, l_extendedprice, l_returnflag, next_key
  from lineitem join tx on l_orderkey = o_orderkey),
latest as (select * from creates_log qualify row_number() over (partition by output_key order by version desc, l_partkey, l_suppkey, l_extendedprice) = 1),
creates as (select output_key, txid, tx_index, vout, block_height, block_hash, block_time, address, value_base, is_spendable from latest),
spends as (select output_key as spent_output_key, n.txid as spent_by_txid, n.block_height as spent_in_block, n.tx_index as spent_tx_index, (row_number() over (partition by n.txid order by output_key) - 1)::bigint as input_index
  from latest join tx n on n.o_orderkey = latest.next_key where l_returnflag = 'R'),
blocks as (select block_height, block_hash, block_time, count(*) as tx_count, case when block_height > 0 then sha256('b' || (block_height - 1)) end as previous_hash from tx group by all),
c as (select max(block_height) as tail, max(block_height) - max(block_height) // 2 as half, max(block_height) - max(block_height) // 10 as tenth from tx),
forked as (select block_height, case when block_height >= tenth then sha256('fork' || block_height) else block_hash end as block_hash, tx_count from blocks, c),
utxo as (select * from creates where not exists (select 1 from spends where spent_output_key = output_key)),
history as (select creates.*, spent_by_txid, spent_in_block, spent_tx_index, input_index from creates left join spends on spent_output_key = output_key),
credits as (select 'core-credit:' || output_key as movement_id, block_height, txid, tx_index, vout as entry_index, address, '' as asset_address, 'credit' as direction, value_base as amount_base, output_key from creates where is_spendable and address <> ''),
debits as (select 'core-debit:' || output_key || ':' || spent_by_txid || ':' || input_index as movement_id, spent_in_block as block_height, spent_by_txid as txid, spent_tx_index as tx_index, input_index as entry_index, address, '' as asset_address, 'debit' as direction, value_base as amount_base, output_key
  from spends join creates on spent_output_key = output_key where is_spendable and address <> ''),
movements as (from credits union all from debits),
balances as (select address, '' as asset_address, sum(value_base)::decimal(38,0) as balance from utxo where is_spendable and address <> '' group by address),
inputs as (select spent_by_txid as txid, count(*) as resolved_inputs, sum(value_base)::decimal(38,0) as input_total from spends join creates on spent_output_key = output_key group by 1),
facts as (select txid, min(block_height) as block_height, min(block_time) as block_time, min(tx_index) as tx_index, count(*) as output_count, sum(value_base)::decimal(38,0) as output_total from creates group by txid),
transactions as (select f.txid, block_height, block_time, tx_index, coalesce(n, 0)::bigint as input_count, output_count, coalesce(input_total, 0)::decimal(38,0) as input_total, output_total, coalesce(n, 0) = 0 as is_coinbase,
  case when coalesce(n, 0) > 0 and input_total <> 0 then (input_total - output_total)::decimal(38,0) end as fee_base
  from facts f left join (select spent_by_txid as txid, count(*) as n from spends group by 1) s on s.txid = f.txid left join inputs on inputs.txid = f.txid),
pos as (select *, (row_number() over (partition by txid order by vout) - 1)::bigint as p from creates),
nested_tx as (select tx.txid, tx.block_height, tx.tx_index, tx.block_hash, coalesce(n, 0) as spent, coalesce(m, 0) as made from tx left join (select spent_by_txid as txid, count(*) as n from spends group by 1) s on s.txid = tx.txid left join (select txid, count(*) as m from creates group by 1) o on o.txid = tx.txid),
refs as (select txid, block_height, block_hash, tx_index, 'core_process' as source, block_height * 1000000 + tx_index * 10 + 1 as version from tx),
late_creates as (select creates.* from creates, c where block_height > tenth),
late_spends as (select spends.* from spends, c where spent_in_block > tenth),
state as (select output_key, txid, block_height, address, value_base, is_spendable, spent_by_txid, spent_in_block, input_index from history),
rewound as (select output_key, txid, block_height, address, value_base, is_spendable, case when spent_in_block < half then spent_by_txid end as spent_by_txid, case when spent_in_block < half then spent_in_block end as spent_in_block, case when spent_in_block < half then input_index end as input_index from state, c where block_height < half),
activity as (select address, sum(case when direction = 'credit' then amount_base else 0 end)::decimal(38,0) as received, sum(case when direction = 'debit' then amount_base else 0 end)::decimal(38,0) as sent, count(distinct txid) as tx_count from movements group by address),
txamounts as (select address, block_height, txid, max(tx_index) as tx_index, sum(case when direction = 'credit' then amount_base else 0 end)::decimal(38,0) as received, sum(case when direction = 'debit' then amount_base else 0 end)::decimal(38,0) as sent from movements group by address, block_height, txid),
deltas as (select address, sum(case when direction = 'credit' then amount_base else -amount_base end)::decimal(38,0) as delta from movements, c where block_height > tenth group by address),
before as (select address, sum(value_base)::decimal(38,0) as balance from history, c where block_height <= tenth and (spent_in_block is null or spent_in_block > tenth) and is_spendable and address <> '' group by address),
texts as (select output_key, vout, value_base from creates),
mem as (select event_id::varchar as txid, epoch(ts) as at, floor(epoch(ts))::bigint as sampled_at, (json_extract(props, '$.k'))::bigint as k, round(value * 1000000)::bigint as fee from events),
samples as (select sampled_at, txid, sampled_at as entry_time, k as size_bytes, fee as fee_base, case when k > 0 then fee * 1000 // k end as fee_rate from mem),
normal as (select txid, sampled_at as time, k + 1 as size, fee as fee_base, fee as modified_fee, fee * 1000 // (k + 1) as fee_rate, event_type as depends from mem join events on event_id::varchar = txid),
snaps as (select distinct floor(epoch(ts) / 3600)::bigint as snapshot, user_id as txid from events),
watches as (select event_id as watch_id, user_id as owner, user_id % 50 as address, 50 as min_value, floor(epoch(ts))::bigint as created_at, floor(epoch(ts))::bigint + 86400 as expires_at from events where event_type = 'signup'),
payments as (select event_id as txid, user_id % 50 as address, round(value)::bigint as value_base, floor(epoch(ts))::bigint as seen_at from events where event_type = 'purchase'),
matches as (select watch_id, w.address, txid, min(seen_at) as seen_at, sum(value_base)::decimal(38,0) as paid, count(*) as outputs from watches w join payments p on p.address = w.address and seen_at >= created_at and seen_at < created_at + 300 group by watch_id, w.address, txid, min_value having sum(value_base) >= min_value),
audit as (select event_id as audit_event_id, user_id as actor, event_type as operation, case when event_type = 'error' then 'failure' else 'success' end as outcome, floor(epoch(ts))::bigint as created_at from events)
"""

#: Base58Check of the hashes that the blocks pay to: 25 bytes as seven numbers of 32 bits, divided by 58 until nothing is left.
_LIMBS = range(7)
_DIVIDED = ", ".join(f"c{i} // 58" for i in _LIMBS)
WIRE = (
    """
  , le as (select output_key, txid, vout, address, lpad(to_hex(value_base), 16, '0') as h from creates),
outs as (select txid, count(*) as n, string_agg(substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)
  || case when address <> '' then '1976a914' || sha1(address) || '88ac' else '016a' end, '' order by vout) as body from le group by txid),
wire_tx as (select tx.txid as own, block_height, tx_index, '0100000001' || repeat('00', 32) || 'ffffffff04' || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) || 'ffffffff' || lpad(to_hex(coalesce(n, 0)), 2, '0') || coalesce(body, '') || '00000000' as raw
  from (select *, lpad(to_hex(tx_index), 8, '0') as x from tx) tx left join outs using (txid)),
hashed_tx as (select own, block_height, tx_index, array_to_string(list_reverse(regexp_extract_all(sha256(unhex(sha256(unhex(raw)))), '..')), '') as txid, length(raw) // 2 as size from wire_tx),
heads as (select block_height, sha256(unhex(sha256(unhex('01000000' || repeat('11', 32) || repeat('22', 32) || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) || 'f0ff0f1e67860100')))) as h
  from (select *, lpad(to_hex(block_time), 8, '0') as x from blocks) b),
payload as (select address, '1e' || sha1(address) as p from (select distinct address from creates where address <> '')),
checked as (select address, '000000' || p || substr(sha256(unhex(sha256(unhex(p)))), 1, 8) as p from payload),
base58 as (select address, 0 as step, '' as text, """
    + ", ".join(f"('0x' || substr(p, {8 * i + 1}, 8))::bigint as l{i}" for i in _LIMBS)
    + " from checked union all select address, step + 1, substr('123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz', (c6 % 58)::int + 1, 1) || text, "
    + _DIVIDED
    + " from (select *, c5 % 58 * 4294967296 + l6 as c6 from (select *, c4 % 58 * 4294967296 + l5 as c5 from (select *, c3 % 58 * 4294967296 + l4 as c4 from (select *, c2 % 58 * 4294967296 + l3 as c3 from (select *, c1 % 58 * 4294967296 + l2 as c2 from (select *, c0 % 58 * 4294967296 + l1 as c1 from (select *, l0 as c0 from base58 where greatest(l0, l1, l2, l3, l4, l5, l6) > 0)))))))),\n"
    + "owners as (select address, arg_max(text, step) as owner from base58 group by address)"
)

SELECTS = {
    "decoded_hashes": WIRE + " select block_height, array_to_string(list_reverse(regexp_extract_all(h, '..')), '') as block_hash, repeat('11', 32) as previous_hash from heads",
    "decoded_transactions": WIRE + " select block_height, tx_index, txid, size from hashed_tx",
    "decoded_addresses": WIRE + " select h.txid || ':' || p as output_key, pos.block_height, pos.tx_index, coalesce(owner, '') as address from pos join hashed_tx h on h.own = pos.txid left join owners using (address)",
    "latest_creates": "select output_key, version, address, value_base from latest",
    "argmax_facts": "select output_key, address, value_base from latest",
    "utxo_as_of": "select output_key, block_height, value_base from history, c where block_height <= half and (spent_in_block is null or spent_in_block > half)",
    "core_blocks_latest": "select block_height, block_hash, 2::bigint as fetched_at from forked",
    "tx_refs_latest": "select * from refs",
    "export_utxo_state": "select output_key, block_height, address, value_base, spent_by_txid, spent_in_block from history",
    "export_balance_state": "from balances",
    "snapshot_violations": """select block_height, 'no hash' as reason from blocks, c where block_height >= tenth and block_height % 3 = 0
      union all select block_height, 'no time' from blocks, c where block_height >= tenth and block_height % 5 = 0 union all select block_height, 'no transactions' from blocks, c where block_height >= tenth and block_height % 7 = 0""",
    "creates": "select txid || ':' || p as output_key, txid, tx_index, vout, block_height, block_hash, block_time, address, value_base, address <> '' as is_spendable, spent = 0 as is_coinbase from (select pos.*, n.spent from pos join nested_tx n on n.txid = pos.txid)",
    "spends": "select pos.txid || ':' || p as spent_output_key, spent_by_txid, spent_in_block, spent_tx_index, input_index from spends join pos on output_key = spent_output_key",
    "processed_blocks": "from blocks",
    "tx_refs": "from refs",
    "block_weights": "select block_height, sum(greatest(spent, 1) + made)::bigint as weight from nested_tx group by 1",
    "nested_block_weights": "select block_height, sum(greatest(spent, 1) + made)::bigint as weight from nested_tx group by 1",
    "output_addresses": "select address, count(*) as outputs from creates where address <> '' group by 1",
    "duplicate_outputs": "select output_key, count(*) as n from creates_log group by 1 having count(*) > 1",
    "duplicate_spends": "select output_key as spent_output_key, count(*) as n from creates_log where l_returnflag = 'R' and next_key is not null group by 1 having count(*) > 1",
    "credit_movements": "from credits",
    "debit_movements": "from debits",
    "movements": "from movements",
    "movements_unique": "select movement_id, direction, amount_base from movements",
    "external_spends": "select spent_output_key as output_key from late_spends where spent_output_key not in (select output_key from late_creates)",
    "touched_outputs": "select output_key from late_creates union select spent_output_key from late_spends",
    "transactions": "from transactions",
    "format_amount": "select output_key, (value_base::decimal(20,0) / 100000000)::decimal(28,8)::varchar as amount from (select output_key, value_base::decimal(28,8) as value_base from creates)",
    "utxo_current": "select output_key, address, value_base, block_height from utxo",
    "utxo_history": "select output_key, value_base, spent_by_txid, spent_in_block, input_index from history",
    "input_totals": "from inputs",
    "utxo_lookup": "select output_key, address, value_base from creates where output_key in (select spent_output_key from spends)",
    "created_lookup": "select output_key, block_height from creates where block_height in (select block_height from blocks where tx_count >= 8)",
    "balance_lookup": "from balances where address in (select address from debits)",
    "read_model_missing": "select output_key, address from creates where output_key in (select spent_output_key from spends)",
    "canonical_tx_refs": "select txid, block_height, tx_index from refs, c where block_height < tenth",
    "pending_blocks": "select forked.* from forked, c where block_height >= tenth",
    "reorg_height": "select tenth as reorg_height from c",
    "fallback_fill": "select output_key, value_base, case when spent_by_txid is null then 'current' else 'history' end as origin from history",
    "combined_summary": """select a.address, coalesce(balance, 0)::decimal(38,0) as balance, received, sent, tx_count, coalesce(n, 0)::bigint as utxo_count from activity a left join balances b on b.address = a.address
      left join (select address, count(*) as n from utxo where is_spendable and address <> '' group by 1) u on u.address = a.address""",
    "resolved_inputs": "select spent_by_txid, input_index, address, value_base from spends left join creates on output_key = spent_output_key",
    "tx_ref_resolve": """select txid, block_height, tx_index, min(priority)::int as priority from (select txid, block_height, tx_index, 0 as priority from refs, c where block_height <= half
      union all select txid, block_height, tx_index, 1 from creates, c where block_height <= tenth union all select txid, block_height, tx_index, 2 from utxo) group by 1, 2, 3""",
    "address_transactions": """select p.txid, p.address, p.block_height, p.tx_index, received, sent, coalesce(input_count, 0)::bigint as input_count, coalesce(output_count, 0)::bigint as output_count, fee_base
      from (from txamounts order by block_height desc, tx_index desc, txid, address limit 500) p left join transactions t on t.txid = p.txid""",
    "balances": "from balances",
    "address_summary": """select address, coalesce(balance, 0)::decimal(38,0) as balance, coalesce(received, 0)::decimal(38,0) as received, coalesce(sent, 0)::decimal(38,0) as sent, coalesce(tx_count, 0)::bigint as tx_count, coalesce(utxo_count, 0)::bigint as utxo_count
      from activity full join (select address, sum(value_base)::decimal(38,0) as balance, count(*) as utxo_count from utxo where is_spendable and address <> '' group by 1) held using (address)""",
    "address_utxo_count": "select address, count(*) as utxo_count from utxo where is_spendable and address <> '' group by 1",
    "address_tx_amounts": "from txamounts",
    "avg_fee": "select round(avg(fee_base::double), 4) as average_fee from transactions",
    "processed_tail": "select tail from c",
    "balance_deltas": "from deltas",
    "next_balances": "select coalesce(b.address, d.address) as address, (coalesce(balance, 0) + coalesce(delta, 0))::decimal(38,0) as balance, coalesce(balance, 0) + coalesce(delta, 0) < 0 as negative from before b full join deltas d on d.address = b.address",
    "movement_balances": "select address, sum(case when direction = 'credit' then amount_base else -amount_base end)::decimal(38,0) as balance from movements group by 1",
    "pro_rata": """select "group", address, (case when row_number() over (partition by "group" order by address desc) = 1 then share + target - sum(share) over (partition by "group") else share end)::decimal(38,0) as allocated
      from (select w.*, (target::hugeint * weight::hugeint) // (sum(weight) over (partition by "group"))::hugeint as share from
        (select spent_by_txid as "group", address, sum(value_base) as weight, any_value(output_total) as target from spends join creates on output_key = spent_output_key join transactions t on t.txid = spent_by_txid where address <> '' group by 1, 2 having sum(value_base) > 0) w)""",
    "applied_exists": "select block_height, block_height < tenth as applied from blocks, c",
    "equal_work_buckets": "select bucket, min(block_height) as first_key from (select block_height, (sum(n) over (order by block_height rows unbounded preceding) // 1000)::bigint as bucket from (select block_height, count(*) as n from creates group by 1)) group by 1",
    "sync_frontier": "select half as frontier from c",
    "chain_violations": "select block_height, 'previous hash' as reason from blocks, c where block_height > tenth",
    "contiguous_range": "select min(block_height) as first, max(block_height) as last, count(*) as blocks, true as contiguous from blocks",
    "blocks_page": "select block_height, block_hash, block_time, tx_count from blocks order by block_height desc limit 50 offset 25",
    "utxo_keyset_page": "select output_key, value_base, case when count(*) over () = 200 then max(output_key) over () end as next_key from (select output_key, value_base from utxo where output_key > 'tx000000000100:0' order by output_key limit 200)",
    "balance_keyset_page": "select *, case when count(*) over () = 20 then max(address || ':' || asset_address) over () end as next_key from (from balances where address > 'S10' order by address limit 20)",
    "top_fees": "select txid, fee_base, block_height, tx_index from transactions where fee_base is not null order by fee_base desc, block_height desc, tx_index desc limit 100",
    "top_transactions": "select txid, output_total, block_height, tx_index from transactions order by output_total desc, block_height desc, tx_index desc limit 100",
    "richest_addresses": "select address, balance from balances order by balance desc, address limit 100",
    "address_utxos": "select address, output_key, block_height, tx_index, vout, value_base from utxo where is_spendable and address <> '' order by block_height desc, tx_index desc, vout, output_key limit 500",
    "search": """, q as (select txid as text from tx where o_orderkey % 50 = 0 union all select unnest([block_height::varchar, ' ' || block_hash || ' ', '-' || block_height]) from blocks where block_height % 50 = 0 union all from (select 'S' || s_suppkey as address from supplier where s_suppkey % 5 = 0))
      select text, 0 as priority, 'block' as kind, text as found, block_height from q join blocks on text = block_height::varchar
      union all select text, 1, 'transaction', tx.txid, tx.block_height from q join tx on tx.txid = trim(text)
      union all select text, 2, 'block', block_hash, block_height from q join blocks on block_hash = trim(text)
      union all select text, 3, 'address', text, null from q where text in (select address from movements)""",
    "decoded_blocks": "select block_height, block_time, tx_count, true as hashed from blocks",
    "decoded_outputs": "select block_height, tx_index, p as vout, value_base, address <> '' as is_spendable, true as is_coinbase from pos",
    "list_blocks": "select block_height, block_hash, block_time, tx_count from blocks, c where block_height % 7 <> 3 and block_height <= tail - 30 and block_height > tail - 80",
    "get_block": """select ref, b.block_height, b.block_hash, b.tx_count as total_count, t.tx_index, t.txid, t.input_count, t.output_count, t.output_total, t.fee_base from
      (select block_height::varchar as ref, block_height from blocks where block_height % 50 = 0 union all select block_hash, block_height from blocks where block_height % 50 = 1
      union all select block_hash, block_height from forked, c where block_height % 50 = 2 and block_height >= tenth) r
      join blocks b on b.block_height = r.block_height join transactions t on t.block_height = b.block_height where t.tx_index between 1 and 20""",
    "get_block_by_hash": "select block_hash, block_height from blocks where block_height % 50 = 1 union all select block_hash, block_height from forked where block_height % 50 = 2",
    "get_transaction_summary": "select txid, block_height, tx_index, greatest(1, input_count)::bigint as vin_size, output_count, output_total, fee_base from transactions where txid in (select txid from tx where o_orderkey % 50 = 0)",
    "get_transaction_inputs": "select spent_by_txid as txid, input_index, spent_output_key as output_key, address, value_base from spends left join creates on output_key = spent_output_key where spent_by_txid in (select txid from tx where o_orderkey % 50 = 0)",
    "get_transaction_outputs": "select txid, vout, output_key, address, value_base, spent_by_txid is not null as spent, spent_by_txid, spent_in_block from history where txid in (select txid from tx where o_orderkey % 50 = 0)",
    "get_address": """select a.address, coalesce(balance, 0)::decimal(38,0) as balance, coalesce(received, 0)::decimal(38,0) as received, coalesce(sent, 0)::decimal(38,0) as sent, coalesce(tx_count, 0)::bigint as tx_count, coalesce(utxo_count, 0)::bigint as utxo_count
      from (select 'S' || s_suppkey as address from supplier where s_suppkey % 5 = 0) a left join activity v on v.address = a.address left join (select address, sum(value_base) as balance, count(*) as utxo_count from utxo where is_spendable group by address) u on u.address = a.address where v.address is not null or u.address is not null""",
    "get_address_transactions": """select p.address, p.txid, p.block_height, t.block_time, p.tx_index, p.received, p.sent, coalesce(t.input_count, 0)::bigint as input_count, coalesce(t.output_count, 0)::bigint as output_count, t.fee_base
      from (select *, row_number() over (partition by address order by block_height desc, tx_index desc, txid) as nth from txamounts where address in (select 'S' || s_suppkey as address from supplier where s_suppkey % 5 = 0)) p left join transactions t on t.txid = p.txid and t.block_height = p.block_height where nth between 6 and 15""",
    "get_address_utxos": "select address, output_key, block_height, tx_index, vout, value_base from utxo where is_spendable and address in (select 'S' || s_suppkey as address from supplier where s_suppkey % 5 = 0) qualify row_number() over (partition by address order by block_height desc, tx_index desc, vout, output_key) between 6 and 15",
    "raw_transactions": "select txid, block_height, block_hash, tx_index from tx, c where txid in (select txid from tx where o_orderkey % 50 = 0) and block_height >= greatest(0, tenth + 1, tail - 999)",
    "transaction_refs": """select txid, block_height, tx_index, min(priority)::int as source from (select txid, block_height, tx_index, 0 as priority from refs, c where block_height <= half
      union all select txid, block_height, tx_index, 1 from creates, c where block_height <= tenth union all select txid, block_height, tx_index, 2 from utxo) where txid in (select txid from tx where o_orderkey % 50 = 0) group by 1, 2, 3""",
    "latest_as_of": "select output_key, version, value_base from (select * from creates_log where version <= 9500 qualify row_number() over (partition by output_key order by version desc, l_partkey, l_suppkey, l_extendedprice) = 1)",
    "utxo_history_as_of": """select output_key, block_height, value_base, case when spent_in_block <= half then spent_by_txid end as spent_by_txid, case when spent_in_block <= half then spent_in_block end as spent_in_block
      from history, c where block_height <= half and output_key in (select spent_output_key from late_spends)""",
    "utxo_versions": "select output_key, coalesce(spent_in_block, block_height) as version from history",
    "chain_violations_stored": "select tenth + 1 as block_height, 'previous hash' as reason from c where tenth < tail",
    "number_units": "select output_key, l_partkey, l_suppkey, (value_base::decimal(38,0) * 1000000)::decimal(38,0) as units from creates_log",
    "hex_units_wide": "select output_key, (value_base::hugeint * 18446744073709551616)::decimal(38,0) as units from creates",
    "parsed_times": "select event_id, case when event_id % 3 < 2 then floor(epoch(ts))::bigint end as seconds from events",
    "balance_keys": "select address, 'x:' || address as asset_address from balances",
    "query_fingerprints": "select c_custkey, sha256('select ' || c_name) as hash from customer",
    "materialized_utxo": "select output_key, address, value_base, half as version from history, c where block_height <= half and (spent_in_block is null or spent_in_block > half)",
    "materialized_balances": "select address, '' as asset_address, sum(value_base)::decimal(38,0) as balance from history, c where block_height <= half and (spent_in_block is null or spent_in_block > half) and is_spendable and address <> '' group by address",
    "materialized_blocks": "select block_height, block_hash, previous_hash from blocks, c where block_height <= half",
    "backfilled_transactions": "select txid, block_height, (fee_base + case when block_height > half then 1000 else 0 end)::decimal(38,0) as fee_base from transactions, c",
    "live_arrivals": """, sound as (select snapshot from snaps group by 1 having count(*) <= 10)
      select snapshot, txid from snaps s where snapshot in (from sound) and not exists (select 1 from snaps o where o.snapshot = s.snapshot - 1 and o.txid = s.txid and o.snapshot in (from sound))""",
    "accepted_watches": """, r as (select watch_id, owner, created_at, expires_at, row_number() over (partition by owner order by created_at, watch_id) as n from watches),
      f as (select watch_id, owner, n, true as accepted, [expires_at] as live from r where n = 1
      union all select r.watch_id, r.owner, r.n, len(list_filter(f.live, lambda e: e > r.created_at)) < 5,
      case when len(list_filter(f.live, lambda e: e > r.created_at)) < 5 then list_append(list_filter(f.live, lambda e: e > r.created_at), r.expires_at) else list_filter(f.live, lambda e: e > r.created_at) end
      from f join r on r.owner = f.owner and r.n = f.n + 1)
      select watch_id, owner, accepted from f""",
    "budget_replay": """, r as (select audit_event_id as request_id, actor as subject, created_at as moment, row_number() over (partition by actor order by created_at, audit_event_id) as n from audit),
      f as (select request_id, subject, n, moment as start, 1::bigint as used, true as allowed from r where n = 1
      union all select request_id, subject, n, case when fresh then moment else start end, case when fresh then 1 else least(used + 1, 5) end, fresh or used < 5 from
      (select r.request_id, r.subject, r.n, r.moment, f.start, f.used, r.moment >= f.start + 86400 as fresh from f join r on r.subject = f.subject and r.n = f.n + 1))
      select request_id, subject, allowed, (5 - used)::bigint as remaining from f""",
    "to_base_units": "select output_key, case when vout % 3 = 0 then value_base when vout % 3 = 2 then -value_base end::decimal(38,0) as units from texts",
    "to_base_units_trunc": "select output_key, case when vout % 3 <> 2 then value_base end::decimal(38,0) as units from texts",
    "hex_units": "select output_key, value_base::decimal(38,0) as units from creates",
    # the rule: user:password@ of a url, and what follows a name and "=" up to white space
    "redact_text": "select c_custkey, 'http://' || case when c_custkey % 2 = 0 then '***:***@' else c_name || '@' end || 'host/x?' || case c_custkey % 3 when 0 then 'Token=*** end' when 1 then 'PASSWORD=*** end' else 'key=' || c_custkey || '&a=1 end' end as redacted from customer",
    "backfilled_in_place": "select txid, block_height, (fee_base + case when block_height > half then 1000 else 0 end)::decimal(38,0) as fee_base from transactions, c",
    "materialized_in_place": "select output_key, address, value_base, tail as version, balance from utxo left join balances using (address), c",
    "followed_state": "select txid || ':' || p as output_key, address, value_base, spent_by_txid, spent_in_block, balance from pos left join spends on spent_output_key = output_key left join balances using (address)",
    "outputs_by_key": "select output_key, address, value_base, block_height, spent_by_txid, spent_in_block from history where output_key in (select txid || ':1' from tx where o_orderkey % 50 = 0)",
    "apply_window_utxo": "from state",
    "apply_window_balances": "from balances",
    "missing_prevouts": "select spent_output_key, spent_by_txid from late_spends where spent_output_key in (select output_key from late_creates)",
    "double_spends": "select spent_output_key, spent_by_txid, spent_in_block + 1 as spent_in_block from late_spends",
    "repair_prevouts": "select output_key, block_height, value_base from history, c where block_height <= half and output_key in (select spent_output_key from late_spends)",
    "rewind_utxo": "from rewound",
    "rewind_balances": "select address, '' as asset_address, sum(value_base)::decimal(38,0) as balance from rewound where spent_by_txid is null and is_spendable and address <> '' group by 1",
    "reorg_replay": """select output_key, txid, block_height, address, value_base, is_spendable, case when ok then spent_by_txid end as spent_by_txid, case when ok then spent_in_block end as spent_in_block, case when ok then input_index end as input_index
      from (select history.*, spent_in_block < tenth or spent_tx_index % 2 = 0 as ok from history, c where block_height < tenth or tx_index % 2 = 0)""",
    "applied_blocks": "select block_height, block_hash, previous_hash from blocks",
    "online_heights": "select unnest(range(greatest(0, least(tail - 49, tail - 50 - 19)), least(tail, tail - 10) + 1))::bigint as block_height from c",
    "finalized_transactions": "select txid, block_height, fee_base from transactions, c where block_height <= tail - 20",
    "balance_invariant": """select b.address, b.balance, m.balance as moved from balances b join (select address, sum(case when direction = 'credit' then amount_base else -amount_base end)::decimal(38,0) as balance from movements group by 1) m on m.address = b.address where m.balance <> b.balance""",
    "block_transactions": "select block_height, tx_index, txid, output_total, fee_base, count(*) over (partition by block_height) as total_count from transactions",
    "tx_inputs": "select spent_by_txid as txid, input_index, spent_output_key as output_key, address, value_base from spends left join creates on output_key = spent_output_key",
    "tx_outputs": "select txid, vout, address, value_base, spent_by_txid is not null as spent, spent_by_txid from history",
    "tx_summary": "select txid, block_height, greatest(1, input_count) as vin_size, output_count, input_total, output_total, fee_base from transactions",
    "block_by_hash": "select block_hash, block_height, tx_count from blocks, c where block_height < tenth",
    "raw_tx_lookup": "select block_height, tx_index, txid, greatest(spent, 1)::bigint as vin_size from nested_tx, c where block_height > tenth",
    "guarded_top_fees": """select txid, fee_base, block_height from transactions, c, (select max(block_time) as stop from blocks, c where block_height = tail - 20)
      where fee_base is not null and block_height <= tail - 20 and block_time >= stop - 604800 and block_time < stop order by fee_base desc, txid limit 1000""",
    "curated_transactions": "select txid, block_height, block_time, tx_index, is_coinbase, input_count, output_count, input_total, output_total, fee_base from transactions",
    "curated_balances": "select address, balance from balances",
    "curated_mempool": "from samples",
    "mempool_samples": "select sampled_at, txid, entry_time, null::bigint as entry_height, size_bytes, fee_base, fee_rate from samples",
    "mempool_entries": "from normal",
    "mempool_page": "select txid, time, size, fee_base from normal order by coalesce(time, -1) desc, txid limit 500",
    "mempool_fee_distribution": "select count(*) as samples, round(avg(fee_rate::double), 4) as average, round(quantile_cont(fee_rate::double, 0.5), 4) as median from samples",
    "mempool_retained": "select txid, sampled_at from samples where sampled_at > (select max(sampled_at) from samples) - 3600",
    "watch_matches": "select watch_id, address, txid, seen_at, paid, outputs from matches",
    "watch_feeds": "select txid, case when seen_at <= (select max(created_at) from watches) then 'catchup' else 'live' end as source from payments",
    "watch_outcomes": """select w.watch_id, case when m.watch_id is null then 'timeout' else 'appeared' end as outcome, m.txid, coalesce(m.seen_at, created_at + 300) as ended_at from watches w left join
      (select m.* from matches m join watches w on w.watch_id = m.watch_id where seen_at >= created_at and seen_at < created_at + 300 qualify row_number() over (partition by m.watch_id order by seen_at, txid) = 1) m on m.watch_id = w.watch_id""",
    "mempool_arrivals": "from snaps s where not exists (select 1 from snaps o where o.snapshot = s.snapshot - 1 and o.txid = s.txid)",
    "mempool_departures": "from snaps s where not exists (select 1 from snaps o where o.snapshot = s.snapshot + 1 and o.txid = s.txid)",
    "mempool_degraded": "select snapshot, count(*) as entries, count(*) > 10 as degraded from snaps group by 1",
    "active_watches": "select watch_id, owner, created_at, row_number() over (partition by owner order by created_at, watch_id) as nth from watches where expires_at > (select max(created_at) from watches)",
    "audit_search": "select audit_event_id, actor, operation, created_at from audit where outcome = 'failure' order by created_at desc, audit_event_id desc limit 500",
    "audit_retained": "select audit_event_id, created_at from audit where created_at >= (select max(created_at) from audit) - 864000",
}

ORACLE_SQL = {name: f"{BASE}{select}" for name, select in SELECTS.items()}
