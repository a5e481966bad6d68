"""Paper accounts: replays that write each account's day once, whatever is run again.

An account is a scenario (scenario_id, params with `start`, a frequency and its costs); its book follows from
its start alone, so a run replays it up to a date and adds the days that are not yet written.  The paper run
of an event strategy rejects shorts.
"""

from __future__ import annotations

import json
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.books import insert_once
from .backtest import cash_backtest, event_backtest, run_scenarios

EQUITY = "scenario_id string, date date, nav double, cash double, positions map<string,double>, n_fills int, n_rejected int"


def replayed(accounts: DataFrame, quotes: DataFrame, until: date, events: bool = False) -> DataFrame:
    """The runs of all accounts from their start to a date."""
    simulate = event_backtest if events else cash_backtest

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        params = json.loads(pdf["params"].iloc[0])
        return simulate(pdf.assign(params=json.dumps(params | ({"shorts": False} if events else {}))))

    return run_scenarios(quotes.where(F.col("date") <= F.lit(until)), accounts, run)


def paper_run(equity: DataFrame, accounts: DataFrame, quotes: DataFrame, until: date, events: bool = False) -> DataFrame:
    """equity with the accounts' days up to a date that it hasn't: a second run of the same date adds nothing."""
    new = replayed(accounts, quotes, until, events).select(*equity.columns)
    return insert_once(equity, new, ["scenario_id", "date"])
