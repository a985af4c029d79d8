from statloom.operators import events
from statloom.plans.ranking import dense_rank_newest_first

CLIENT = '<action name="client_app_name"><value>app</value></action>'


def shred(frame, *documents):
    df = frame("object_name string, event_xml string", *[("x", d) for d in documents])
    return events.event_shred(df).collect(), events.event_rejects(df).count()


def test_missing_nodes_are_null_and_the_first_of_two_wins(frame):
    rows, rejects = shred(frame, f'<event name="e" timestamp="2024-01-01T00:00:00Z">'
                                 f'<data name="cpu_time"><value>7</value></data>'
                                 f'<data name="cpu_time"><value>8</value></data>'
                                 f'<data name="writes"><value>many</value></data>{CLIENT}</event>')
    assert rejects == 0
    row = rows[0]
    assert (row.event_name, row.cpu_time, row.writes, row.duration, row.sql_text) == ("e", 7, None, None, None)
    assert row.client_app_name == "app" and row.timestamp.year == 2024


def test_event_without_client_name_and_excluded_client_are_dropped(frame):
    excluded = CLIENT.replace("app<", events.EXCLUDED_CLIENT + "<")
    rows, rejects = shred(frame, '<event name="e"/>', f'<event name="e">{excluded}</event>',
                          f'<event name="f">{CLIENT}</event>')
    assert [r.event_name for r in rows] == ["f"] and rejects == 0


def test_malformed_documents_are_counted_not_raised(frame):
    rows, rejects = shred(frame, "<event name=", "no xml", f'<event name="f">{CLIENT}</event>')
    assert len(rows) == 1 and rejects == 2


def test_no_document_is_lost_wherever_its_fault_is(frame):
    def doc(n, statement="1", client=CLIENT):
        return (f'<event name="e" timestamp="2024-01-01T00:00:00Z"><data name="statement"><value>{statement}</value></data>'
                f'<data name="duration"><type name="int64"/><value>{3_000_000_000 + n}</value><text/></data>{client}</event>')
    whole = doc(0)
    excluded = doc(1, client=CLIENT.replace("app<", events.EXCLUDED_CLIENT + "<"))
    broken = [doc(2, "where x = 1 & 2"), *[whole[:n] for n in range(1, len(whole), 7)], whole.replace("<value>1", "<value><1")]
    documents = [whole, excluded, doc(3, client=""), *broken]
    rows, rejects = shred(frame, *documents)
    assert (len(rows), rejects) == (1, len(broken)) and rows[0].duration == 3_000_000_000
    df = frame("object_name string, event_xml string", *[("error_reported", d) for d in broken])
    assert events.failover_events(df).count() == 0


def test_blanks_are_kept_and_both_quotes_order(frame):
    def doc(day, quote):
        return (f"<event name={quote}d{day}{quote} timestamp={quote}2024-01-0{day}T00:00:00Z{quote}><data name='statement'>"
                f"<value>  a\n\n </value></data>{CLIENT}</event>")
    rows, _ = shred(frame, doc(3, "'"), doc(1, "'"), doc(2, '"'))
    assert [r.event_name for r in rows] == ["d1", "d2", "d3"] and rows[0].statement == "  a\n\n "


def test_escaped_text_is_decoded_and_order_is_by_time(frame):
    def doc(day):
        return (f'<event name="d{day}" timestamp="2024-01-0{day}T00:00:00.5Z"><data name="statement">'
                f'<value>a &lt; b &amp;&amp; c</value></data>{CLIENT}</event>')
    rows, _ = shred(frame, doc(3), doc(1), doc(2))
    assert [r.event_name for r in rows] == ["d1", "d2", "d3"]
    assert rows[0].statement == "a < b && c"


def test_slow_events_at_the_threshold_and_transaction_states(frame):
    df = frame("object_name string, duration bigint, transaction_state int",
               ("rpc_completed", 500000, None), ("rpc_completed", 499999, None), ("sql_transaction", 500000, 1),
               ("sql_transaction", 500000, 3), ("sql_transaction", 900000, None), ("other", 900000, 1))
    got = [(r.object_name, r.transaction_state) for r in events.slow_event_filter(df).collect()]
    assert got == [("rpc_completed", None), ("sql_transaction", 1)]


def test_two_level_dense_rank_with_ties_and_minute_borders(frame):
    times = ["00:00:01", "00:00:01", "00:00:59", "00:01:00", "00:01:00", "00:05:00"]
    df = frame("g string, at timestamp", *[("a", f"2024-01-01 {t}") for t in times], ("b", "2024-01-01 00:00:01"))
    got = sorted((r.g, r.at.strftime("%H:%M:%S"), r.rank_no) for r in dense_rank_newest_first(df, ["g"], "at").collect())
    assert got == [("a", "00:00:01", 4), ("a", "00:00:01", 4), ("a", "00:00:59", 3), ("a", "00:01:00", 2),
                   ("a", "00:01:00", 2), ("a", "00:05:00", 1), ("b", "00:00:01", 1)]
