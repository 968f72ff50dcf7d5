"""A feed that only shows its present state, as a stream: polled at most once a time to live, every poll kept to be read again.

The offset is the number of polls taken. A poll is stored whole in the shared folder before it is part of a batch, so a batch that
fails, or a query that starts again from its checkpoint, reads what was stored and asks the feed for nothing; polls of an unchanged
feed are not stored twice. Downstream, alerts already seen are dropped by key (see corduroy.streaming.live.new_alerts).
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.text import first_number

#: The feed's lists by state, and the seconds for which a poll is good.
STATES = {"normal": "NORMAL", "restringido": "RESTRINGIDO", "interrumpido": "INTERRUMPIDO"}
TTL_S = 15 * 60
#: Patterns of an alert's cause, in order; what fits none is OTRO.
CAUSES = (
    ("ACCIDENTE", "choque|accidente|colisi|volcadur|despiste|atropell|choques"),
    ("FENOMENO", "derrumb|huayco|huaico|lluvia|nevad|deslizam|inundac|crecid|alud|piedras|rocas|erosi"),
    ("INFRAESTRUCTURA", "mantenimiento|obra|conservacion|pavimento|puente|plataforma|señal|senal|asfalto|construccion"),
    ("HUMANO", "bloqueo|cierre|manifest|protesta|piquete|poblador|paro"),
)


class Poll(InputPartition):
    """One stored poll."""

    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PolledFeed(DataSource):
    """Options: feed (a URL), store (a folder that driver and executors share), ttl (seconds, 900 unless given)."""

    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> str:
        return "poll long, polled_at timestamp, estado string, feature string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PolledReader(self.options["feed"], self.options["store"], float(self.options.get("ttl", TTL_S)))


class PolledReader(DataSourceStreamReader):
    def __init__(self, feed: str, store: str, ttl: float):
        self.feed, self.store, self.ttl = feed, store, ttl

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.store)

    def _file(self, root: str, number: int) -> str:
        return f"{root}/poll-{number:012d}.json"

    def _stored(self) -> list[int]:
        """Numbers of the stored polls, in order."""
        from pyarrow import fs

        files, root = self._fs()
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name[5:-5]) for f in found if f.base_name.startswith("poll-") and f.base_name.endswith(".json"))

    def _read(self, number: int) -> dict:
        files, root = self._fs()
        with files.open_input_stream(self._file(root, number)) as f:
            return json.loads(f.read())

    def _fetch(self) -> str:
        from urllib.request import urlopen

        with urlopen(self.feed, timeout=60) as answer:
            return answer.read().decode("utf-8-sig", errors="replace")

    def _poll(self) -> int:
        """Ask the feed unless the newest poll is still good; the number of polls then stored."""
        stored = self._stored()
        last = self._read(stored[-1]) if stored else None
        if last and time.time() - last["checked"] < self.ttl:
            return stored[-1]
        try:
            body = self._fetch()
            json.loads(body)
        except (OSError, ValueError):
            return stored[-1] if stored else 0  # a feed that is down or broken is asked again at the next trigger
        digest = hashlib.sha256(body.encode()).hexdigest()
        same = bool(last) and last["digest"] == digest
        number = stored[-1] if same else (stored[-1] if stored else 0) + 1
        files, root = self._fs()
        files.create_dir(root, recursive=True)
        record = json.dumps({"at": last["at"] if same else time.time(), "checked": time.time(), "digest": digest, "body": body})
        with files.open_output_stream(f"{root}/_next") as f:
            f.write(record.encode())
        files.move(f"{root}/_next", self._file(root, number))  # whole or not at all
        return number

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def latestOffset(self) -> dict:
        return {"polls": self._poll()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Poll(n) for n in range(start["polls"] + 1, end["polls"] + 1)]

    def read(self, partition: Poll) -> Iterator[tuple]:
        from datetime import datetime, timezone

        poll = self._read(partition.number)
        at = datetime.fromtimestamp(poll["at"], timezone.utc)
        body = json.loads(poll["body"])
        for key, state in STATES.items():
            for feature in body.get(key) or []:
                yield partition.number, at, state, json.dumps(feature, ensure_ascii=False)

    def commit(self, end: dict) -> None:
        """Stored polls stay: they are the feed's history, and cheap."""


def polled(spark: SparkSession, feed: str, store: str, ttl: float = TTL_S) -> DataFrame:
    """The stream of a feed's polls: poll, polled_at, estado, feature (JSON)."""
    spark.dataSource.register(PolledFeed)
    return spark.readStream.format("polled").option("feed", feed).option("store", store).option("ttl", str(ttl)).load()


def cause(event: Column) -> Column:
    """The first pattern of CAUSES that an alert's event fits."""
    found = F.lit("OTRO")
    for name, pattern in reversed(CAUSES):
        found = F.when(event.rlike(f"(?i){pattern}"), name).otherwise(found)
    return found


def alerts(polls: DataFrame) -> DataFrame:
    """A row per alert of polls (poll, polled_at, estado, feature), also of a stream; a feature's own state goes before its list's."""
    properties = "item string, estado string, evento string, afectacion string, ubigeo string, fecha_evento string, fecha_actualizacion string, tipo_alerta_ string, longitud string, latitud string"
    f = polls.withColumn("_f", F.from_json("feature", f"struct<geometry: struct<coordinates: array<double>>, properties: struct<{properties.replace(' string', ': string')}>>"))
    p = lambda c: F.coalesce(F.col(f"_f.properties.{c}"), F.lit(""))
    place = lambda i, c: F.coalesce(F.get("_f.geometry.coordinates", F.lit(i)), F.col(f"_f.properties.{c}").try_cast("double"), F.lit(0.0))
    return f.select(
        "poll", "polled_at", p("item").alias("item"), F.coalesce("_f.properties.estado", "estado").alias("estado"), cause(p("evento")).alias("motivo"), p("evento").alias("evento"), p("afectacion").alias("afectacion"),
        first_number(p("afectacion")).alias("km"), p("ubigeo").alias("ubigeo"), p("fecha_evento").alias("fecha_evento"), p("fecha_actualizacion").alias("fecha_actualizacion"), p("tipo_alerta_").alias("tipo_alerta"),
        place(0, "longitud").alias("lon"), place(1, "latitud").alias("lat"),
    )
