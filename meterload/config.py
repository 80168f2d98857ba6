"""Settings of the engine: calendar window, window sizes, sensors, cleaning rules."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from datetime import datetime

# Sensor columns of the raw readings, in file order.
SENSORS = (
    "air1", "air2", "air3", "airwindowunit1", "aquarium1", "bathroom1", "bathroom2", "bedroom1",
    "bedroom2", "bedroom3", "bedroom4", "bedroom5", "battery1", "car1", "car2", "circpump1",
    "clotheswasher1", "clotheswasher_dryg1", "diningroom1", "diningroom2", "dishwasher1",
    "disposal1", "drye1", "dryg1", "freezer1", "furnace1", "furnace2", "garage1", "garage2",
    "grid", "heater1", "heater2", "heater3", "housefan1", "icemaker1", "jacuzzi1", "kitchen1",
    "kitchen2", "kitchenapp1", "kitchenapp2", "lights_plugs1", "lights_plugs2", "lights_plugs3",
    "lights_plugs4", "lights_plugs5", "lights_plugs6", "livingroom1", "livingroom2", "microwave1",
    "office1", "outsidelights_plugs1", "outsidelights_plugs2", "oven1", "oven2", "pool1", "pool2",
    "poollight1", "poolpump1", "pump1", "range1", "refrigerator1", "refrigerator2", "security1",
    "sewerpump1", "shed1", "solar", "solar2", "sprinkler1", "sumppump1", "utilityroom1",
    "venthood1", "waterheater1", "waterheater2", "wellpump1", "winecooler1",
)
GENERATORS = ("solar", "solar2", "battery1")
BALANCE_SENSOR = "grid"
FEATURES = ("dayofyear", "season", "month", "dayofweek", "hourofday", "minuteofhour", "typeofday")
LEVELS = ("appliance", "household", "community", "city")


@dataclass(frozen=True)
class Config:
    """All tunables of a run. Times are naive and mean UTC."""

    # The calendar window and model sizes every table is aligned to.
    from_time: datetime = datetime(2018, 6, 1, 5, 0)
    end_time: datetime = datetime(2018, 9, 1, 4, 45)
    step_seconds: int = 900
    input_size: int = 288
    output_size: int = 48
    test_fraction: float = 0.2
    val_fraction: float = 0.2
    folds: int = 3
    community_size: int = 5
    fill_rows: int = 5
    z_limit: float = 3.0

    time_column: str = "local_15min"
    sensors: tuple[str, ...] = SENSORS
    generators: tuple[str, ...] = GENERATORS
    balance_sensor: str = BALANCE_SENSOR
    outliers: str | None = "row_zscore"     # "row_zscore", "abs_limit" or None
    value_limit: float = 1000.0             # used by "abs_limit", in the unit of the readings
    duplicates: str | None = "avg"          # readings of one slot: avg, sum, min, max; None: unique
    block_rows: int = 16384                 # longest run of grid rows one task sorts for an entity
    years: bool = field(default=True)       # shift each household by its delta_year

    def __post_init__(self) -> None:
        if self.end_time < self.from_time:
            raise ValueError("end_time lies before from_time")
        if self.step_seconds <= 0 or self.input_size <= 0 or self.output_size <= 0:
            raise ValueError("step_seconds, input_size and output_size must be positive")

    @property
    def n_steps(self) -> int:
        """Rows of the regular grid, both ends included."""
        span = (self.end_time - self.from_time).total_seconds()
        return math.floor(span / self.step_seconds) + 1

    @property
    def span(self) -> int:
        return self.input_size + self.output_size

    @property
    def boundary(self) -> int:
        """Last grid index of the training part."""
        return math.floor((1 - self.test_fraction) * self.n_steps)

    @property
    def test_start(self) -> int:
        return self.boundary + 1

    @property
    def last_window(self) -> int:
        return self.n_steps + 1 - self.span

    @property
    def last_train_window(self) -> int:
        return self.boundary + 1 - self.span

    @property
    def appliances(self) -> tuple[str, ...]:
        """Sensors that are entities of the appliance level: all but the balance sensor."""
        return tuple(s for s in self.sensors if s != self.balance_sensor)

    @property
    def consumers(self) -> tuple[str, ...]:
        return tuple(s for s in self.appliances if s not in self.generators)

    @property
    def active_generators(self) -> tuple[str, ...]:
        return tuple(s for s in self.appliances if s in self.generators)

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)
