from pyspark.sql import functions as F

from chorusframe.operators import sessions


def numbers(df, col):
    return [r[col] for r in df.orderBy("start_s", "det_id").collect()]


def test_starts_within_the_gap_are_one_event(det):
    assert numbers(det([0, 1, 2]).transform(sessions.assign_events()), "event_no") == [1, 1, 1]


def test_a_longer_gap_begins_another(det):
    assert numbers(det([0, 1, 10]).transform(sessions.assign_events()), "event_no") == [1, 1, 2]


def test_touching_windows_merge(det):
    assert sessions.events(det([0, 2])).count() == 1
    assert sessions.events(det([0, 2.5])).count() == 2


def test_species_and_recordings_are_apart(det):
    both = det([0, 1]).union(det([0, 1], species="b")).union(det([0, 1], recording="r2"))
    assert sessions.events(both).count() == 3


def test_one_call_makes_the_event_a_call_and_mixed(det):
    row = sessions.events(det([(0, "call"), (1, "false_positive")])).first()
    assert (row["verdict"], row["mixed"], row["call_windows"], row["duration_s"]) == ("call", True, 1, 3.0)


def test_unreviewed_event_has_no_verdict(det):
    assert sessions.events(det([0])).first()["verdict"] is None


def test_singleton_episode_features(det):
    row = det([7]).transform(sessions.episode_features(300.0)).first()
    assert (row["episode_mean_gap_s"], row["episode_position"], row["episode_size"], row["episode_rate"]) == (300.0, 0.0, 1, 1.0)


def test_gap_to_nearest(det):
    assert numbers(sessions.gap_to_nearest(det([0, 3, 10])), "gap_to_nearest_s") == [3.0, 3.0, 7.0]
    assert numbers(sessions.gap_to_nearest(det([5])), "gap_to_nearest_s") == [None]


def test_empty_table(det):
    none = det([0]).where(F.lit(False))
    assert sessions.events(none).count() == 0
    assert sessions.event_effort(none).where("station <> 'ALL'").count() == 0


def test_episode_effort_counts_pure_episodes_once(det):
    rows = {r["station"]: r for r in sessions.episode_effort(det([(0, "call"), (10, "call"), (1000, "call"), (1010, "false_positive")])).collect()}
    assert rows["ALL"]["listens"] == 3 and rows["ALL"]["episodes"] == 2
