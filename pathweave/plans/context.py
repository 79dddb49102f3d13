"""Build context: raw frames, window, parameters and the summary tables, built lazily
once per context so that one query plan reuses the same sub-plans."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from pathweave.config import TESTDATA_PARAMS, JobParams
from pathweave.operators import game as G
from pathweave.operators import web as Wb
from pathweave.schema import RAW_EVENT
from pathweave.sources.events import read_export, resolve_window, scan_events_window, window_days, window_end_date
from pathweave.sources.store import TableStore
from pathweave.sources.testdata import ga4_events
from pathweave.session import prepare


_WINDOWS: dict[str, tuple[str, str]] = {}


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str, params: JobParams = TESTDATA_PARAMS,
                 window_request_days: int | None = None, materialize: bool = True,
                 export_paths: dict[str, str] | None = None):
        """``export_paths``: product ("web", "game") -> a stored export (Parquet partitioned by
        event_date); without it the synthetic events of ``sf_dir`` stand in for one."""
        self.spark = prepare(spark)
        self.sf_dir = sf_dir
        self.export_paths = export_paths or {}
        self.base_params = params
        self.window_request_days = window_request_days or params.window_days
        self.materialize = materialize

    @cached_property
    def store(self) -> TableStore:
        inputs = tuple(self.export_paths.values()) or (f"{self.sf_dir}/events.parquet",)
        return TableStore(self.spark, ("v2", self.sf_dir, self.base_params, self.window_request_days, sorted(self.export_paths.items())), inputs)

    def rebuilding(self) -> Ctx:
        """A context of the same inputs whose first use of each summary table writes it anew."""
        c = Ctx(self.spark, self.sf_dir, self.base_params, self.window_request_days, export_paths=self.export_paths)
        c.store.rebuild()
        return c

    def _table(self, name: str, build) -> DataFrame:
        return self.store.get(name, build) if self.materialize else build()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def export(self, product: str) -> DataFrame:
        """The raw event export of ``product``: the synthetic table mapped once and
        stored as Parquet partitioned by event_date (the shape of a real export)."""
        if product in self.export_paths:
            return read_export(self.spark, self.export_paths[product])
        if not self.materialize:
            return ga4_events(self.spark, self.sf_dir, product)
        df = self.store.get(f"export_{product}", lambda: ga4_events(self.spark, self.sf_dir, product, by_day=True),
                            partition_by=["event_date"], schema=RAW_EVENT, is_input=True)
        return df.select(*RAW_EVENT.fieldNames())

    def export_path(self, product: str) -> str:
        if product in self.export_paths:
            return self.export_paths[product]
        self.export(product)
        return f"{self.store.root}/export_{product}"

    @cached_property
    def window(self) -> tuple[str, str]:
        # looked up once for each input: an export answers from its day folders (only the
        # partition column is read), the synthetic events by a scan of ``ts``
        key = f"{self.spark.sparkContext.applicationId}:{self.store.root}"
        if key not in _WINDOWS:
            product = next(iter(self.export_paths), None)
            days = self.export(product) if product else ga4_events(self.spark, self.sf_dir, "web")
            _WINDOWS[key] = resolve_window(days, self.window_request_days)
        return _WINDOWS[key]

    @cached_property
    def w_end(self):
        return window_end_date(self.window)

    @cached_property
    def params(self) -> JobParams:
        return self.base_params.with_window(window_days(self.window))

    @cached_property
    def raw_web(self) -> DataFrame:
        return scan_events_window(self.export("web"), *self.window, require_user=False)

    @cached_property
    def raw_game(self) -> DataFrame:
        return scan_events_window(self.export("game"), *self.window, require_user=False)

    # web
    @cached_property
    def web_events(self) -> DataFrame:
        """Flat in-session web events (parameters extracted once, then stored)."""
        return self._table("web_events", lambda: Wb.web_session_events(self.raw_web))

    @cached_property
    def web_sessions(self) -> DataFrame:
        return self._table("web_sessions", lambda: Wb.web_sessions(self.raw_web, self.params, self.web_events))

    @cached_property
    def web_journeys(self) -> DataFrame:
        return self._table("web_journeys", lambda: Wb.web_user_journeys(self.web_sessions, self.w_end, self.params))

    # game
    @cached_property
    def game_events(self) -> DataFrame:
        """Flat in-session game events (parameters extracted once, then stored)."""
        return self._table("game_events", lambda: G.game_session_events(self.raw_game))

    @cached_property
    def game_sessions(self) -> DataFrame:
        return self._table("game_sessions", lambda: G.game_sessions(self.raw_game, self.params, self.game_events))

    @cached_property
    def ufo(self) -> DataFrame:
        return self._table("ufo", lambda: G.user_first_open(self.raw_game))

    @cached_property
    def gameplay(self) -> DataFrame:
        """Flat in-session gameplay events: parameters extracted once, then stored."""
        return self._table("gameplay", lambda: G.gameplay_events(self.raw_game))

    @cached_property
    def stitched(self) -> DataFrame:
        """Gameplay events with the attempt they belong to: stored, as the attempt build reads them twice."""
        return self._table("stitched", lambda: G.stitch_attempts(self.gameplay, self.params))

    @cached_property
    def attempts(self) -> DataFrame:
        return self._table("attempts", lambda: G.level_attempts(self.raw_game, self.ufo, self.params, self.stitched))

    @cached_property
    def game_journeys(self) -> DataFrame:
        return self._table("game_journeys", lambda: G.game_user_journeys(self.game_sessions, self.attempts, self.ufo, self.w_end, self.params))

    @cached_property
    def qa(self) -> DataFrame:
        """game_events_test: every raw event with its attempt span."""
        from pathweave.operators.qa import event_attempt_qa
        return self._table("qa", lambda: event_attempt_qa(self.raw_game, self.attempts, self.params))

    @cached_property
    def game_levels(self) -> DataFrame:
        return self._table("game_levels", lambda: G.game_levels(self.attempts, self.game_journeys))
