"""Registry of every named query (``queries()``) and its oracle SQL."""

from __future__ import annotations

from pipework.plans import oracle as O
from pipework.plans.panels import PANELS, RANGED

QUERIES: dict = {}
ORACLE: dict = {}

QUERIES.update(PANELS)
QUERIES.update(RANGED)
ORACLE.update(O.panel_sql())

from pipework.plans.alerts import ALERTS  # noqa: E402

QUERIES.update(ALERTS)
ORACLE.update(O.alert_sql())

from pipework.plans.monitoring import MONITORING  # noqa: E402

QUERIES.update(MONITORING)
ORACLE.update(O.monitoring_sql())

from pipework.plans.state import STATE  # noqa: E402

QUERIES.update(STATE)
ORACLE.update(O.state_sql())

from pipework.plans.flows import FLOWS  # noqa: E402

QUERIES.update(FLOWS)
ORACLE.update(O.flow_sql())

from pipework.plans.catalogue import CATALOGUE  # noqa: E402

QUERIES.update(CATALOGUE)
ORACLE.update(O.catalogue_sql())
