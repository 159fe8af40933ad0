import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from touchline.session import SETTINGS

    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    session = builder.config(map=SETTINGS).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def league(spark):
    """Four teams, twelve rounds of all pairs, a match every third day, scores by rule; each side with one source's statistics."""
    matches, stats, day = [], [], dt.date(2025, 1, 1)
    for cycle in range(12):
        for i in range(4):
            for j in range(4):
                if i == j:
                    continue
                n = len(matches)
                on = day + dt.timedelta(days=3 * n)
                h, a = (i + cycle) % 4, (j + cycle) % 3
                kick = dt.datetime.combine(on, dt.time(15))
                matches.append((n, 1, i, j, h, a, h // 2, a // 2, on, True, kick, "played", "Test Referee", kick + dt.timedelta(minutes=150)))
                for team, g in ((i, h), (j, a)):
                    stats.append((n, team, 0, 0.9, 10 + g, 3 + g, 4 + g % 3, 9 + g, 1 + g % 2, 0, None, n))
    m = spark.createDataFrame(matches, "id long, competition_id long, home_team_id long, away_team_id long, ft_home_goals int, ft_away_goals int, ht_home_goals int, ht_away_goals int, kickoff_date date, kickoff_is_exact boolean, kickoff_utc timestamp, status string, referee string, known_at timestamp")
    s = spark.createDataFrame(stats, "match_id long, team_id long, source_id int, reliability double, shots int, shots_on_target int, corners int, fouls int, yellows int, reds int, xg double, arrival long")
    return m.cache(), s.cache()
