"""Object stores: settings from the environment for Spark's S3A connector, and a round trip to see that one can be reached."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..errors import BackendError


@dataclass(frozen=True)
class ObjectStore:
    """Where a bucket is and how to get in. Credentials aren't shown."""

    endpoint: str
    bucket: str
    access_key: str = field(repr=False)
    secret_key: str = field(repr=False)
    region: str = "us-east-1"
    path_style: bool = True

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> ObjectStore:
        env = os.environ if env is None else env
        lacking = [k for k in ("S3_ENDPOINT", "S3_BUCKET", "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY") if not env.get(k)]
        if lacking:
            raise BackendError(f"{', '.join(lacking)} must be set")
        return cls(env["S3_ENDPOINT"], env["S3_BUCKET"], env["AWS_ACCESS_KEY_ID"], env["AWS_SECRET_ACCESS_KEY"], env.get("AWS_REGION", "us-east-1"), env.get("S3_PATH_STYLE", "true").lower() != "false")

    def conf(self) -> dict[str, str]:
        """Hadoop settings of the connector, with checksums of what is put."""
        own = f"fs.s3a.bucket.{self.bucket}."
        return {
            f"{own}endpoint": self.endpoint, f"{own}endpoint.region": self.region, f"{own}path.style.access": str(self.path_style).lower(), f"{own}access.key": self.access_key, f"{own}secret.key": self.secret_key,
            f"{own}connection.ssl.enabled": str(self.endpoint.startswith("https")).lower(), "fs.s3a.create.checksum.algorithm": "CRC32C",
        }

    def connect(self, spark: SparkSession) -> str:
        """Make the settings known to Spark; the bucket's URI."""
        for k, v in self.conf().items():
            spark.sparkContext._jsc.hadoopConfiguration().set(k, v)
        return f"s3a://{self.bucket}"


def ping(spark: SparkSession, folder: str) -> bytes:
    """Put a small object into folder, read it again, take it away; what was read."""
    jvm, path = spark.sparkContext._jvm, f"{folder.rstrip('/')}/ping-{uuid.uuid4().hex}"
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    sent = b"ping " + uuid.uuid4().hex.encode()
    try:
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(hadoop)
        out.write(bytearray(sent))
        out.close()
        got = bytes(spark.read.format("binaryFile").load(path).first()["content"])
        fs.delete(hadoop, False)
    except Exception as e:
        raise BackendError(f"{folder} can't be reached: {e}") from e
    if got != sent:
        raise BackendError(f"{folder} gave back other bytes than were put")
    return got
