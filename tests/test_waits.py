import hashlib

from statloom.operators import waits

WAIT = ("server_name string, wait_type string, collect_date timestamp, waiting_tasks_count bigint, "
        "wait_time_ms bigint, max_wait_time_ms bigint, signal_wait_time_ms bigint")


def test_benign_and_unused_waits_are_dropped_whatever_their_case(frame):
    df = frame(WAIT, ("s", "xe_timer_event", "2024-01-01", 5, 1, 1, 1), ("s", "LCK_M_X", "2024-01-01", 0, 1, 1, 1),
               ("s", "LCK_M_S", "2024-01-01", 1, 1, 1, 1))
    assert [r.wait_type for r in waits.wait_snapshot_filter(df).collect()] == ["LCK_M_S"]


def test_number_of_benign_waits():
    assert len(waits.BENIGN_WAITS) == len(set(waits.BENIGN_WAITS)) == 73
    assert len(waits.CATEGORY_RULES) + len(waits.CATEGORY_LITERALS) == 24


def test_null_reset_and_standstill_give_zero_and_counts_stay_cumulative(frame):
    df = frame(WAIT, ("s", "A", "2024-01-01", 5, None, 9, 3), ("s", "A", "2024-01-02", 8, 10, 9, 5),
               ("s", "A", "2024-01-03", 9, 4, 9, 5))
    got = {r.collect_date.day: (r.waiting_tasks_count, r.wait_time_ms, r.max_wait_time_ms, r.signal_wait_time_ms)
           for r in waits.wait_delta(df).collect()}
    assert got == {2: (8, 0, 9, 2), 3: (9, 0, 9, 0)}


def test_tie_at_the_last_rank_breaks_on_the_name(frame):
    rows = [("s", f"W{n:02d}", "2024-01-01", 1, 7 if n >= 9 else 100 - n, 1, 1) for n in range(12)]
    got = sorted(r.wait_type for r in waits.wait_top_n(frame(WAIT, *rows), 10).collect())
    assert got == [f"W{n:02d}" for n in range(10)]


def categories(frame, *names):
    df = frame("wait_type string", *[(n,) for n in names])
    rows = {(r.wait_category, r.wait_type) for r in waits.wait_categorize(df).collect()}
    assert set(waits.CATEGORY_LITERALS) <= rows
    return rows - set(waits.CATEGORY_LITERALS)


def test_patterns_ignore_case_and_underscore_is_a_wildcard(frame):
    assert categories(frame, "lck_m_x", "LATCHX", "LATCH", "SOS_SCHEDULER_YIELD", "NOTHING") == {
        ("Lock", "lck_m_x"), ("Latch", "LATCHX")}


def test_overlapping_rules_give_two_rows_and_exclusions_hold(frame):
    got = categories(frame, "BROKER_RECEIVE_WAITFOR", "HADR_THROTTLE_LOG_RATE_GOVERNOR", "PWAIT_HADR_X", "CHKPT")
    assert got == {("User Wait", "BROKER_RECEIVE_WAITFOR"), ("Log Rate Governor", "HADR_THROTTLE_LOG_RATE_GOVERNOR"),
                   ("Replication", "PWAIT_HADR_X"), ("Tran Log IO", "CHKPT")}
    assert categories(frame, "SQLCLR_X", "CLR_X", "dtc_1", "TRANSACTION_MUTEX") == {
        ("CLR", "SQLCLR_X"), ("CLR", "CLR_X"), ("Transaction", "dtc_1"), ("Transaction", "TRANSACTION_MUTEX")}


def test_rollup_is_the_same_from_rules_and_from_a_mapping_table(frame):
    rows = [("s", n, "2024-01-01", 1, 10 * k, 1, k) for k, n in
            enumerate(["LCK_M_X", "lck_m_s", "XYZ", "SOS_SCHEDULER_YIELD", "CHKPT", "threadpool"], 1)]
    df = frame(WAIT, *rows)
    from_rules = {(r.wait_category, r.wait_time_ms) for r in waits.wait_category_rollup(df).collect()}
    mapped = {(r.wait_category, r.wait_time_ms)
              for r in waits.wait_category_rollup(df, waits.wait_categorize(df)).collect()}
    assert from_rules == mapped == {("Lock", 30), ("Unknown", 30), ("Cpu", 40), ("Tran Log IO", 50),
                                    ("Worker Thread", 60)}


def test_the_list_of_benign_waits_is_unchanged():
    """The oracle takes the list from the operator, so an edit would pass unseen without this sum."""
    listed = "\n".join(sorted(waits.BENIGN_WAITS))
    assert len(waits.BENIGN_WAITS) == 73 and hashlib.md5(listed.encode()).hexdigest() == "ef08aaff406c44503dfa3b70e67679a5"
