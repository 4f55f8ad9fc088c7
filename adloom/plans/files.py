"""Small files beside the state tables, in any file system that Spark's own tables may lie in.

The driver writes and lists them; rows never pass through here.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: What a file system answers if a name is taken.
TAKEN = ("FileAlreadyExistsException", "already exists")


class Files:
    """Listing, reading, deleting, and writing that happens whole or not at all."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._hadoop = self._jvm.org.apache.hadoop.fs

    def _of(self, path: str):
        place = self._hadoop.Path(path)
        return place.getFileSystem(self._conf), place

    def names(self, folder: str) -> list[str]:
        """Names in a folder, none if there is no such folder; hidden ones are left out."""
        system, place = self._of(folder)
        if not system.exists(place):
            return []
        found = (status.getPath().getName() for status in system.listStatus(place))
        return sorted(name for name in found if name[0] not in "._")

    def read(self, path: str) -> str:
        system, place = self._of(path)
        stream = system.open(place)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def mark(self, path: str) -> None:
        """Make an empty file, whose name is all that counts."""
        system, place = self._of(path)
        system.createNewFile(place)

    def delete(self, path: str) -> None:
        system, place = self._of(path)
        system.delete(place, True)

    def put(self, path: str, text: str, replace: bool = False) -> bool:
        """Write a file; without ``replace`` only one of several writers succeeds.

        The text is written under a hidden name first, and that is then given its name, so
        that no reader meets half a file. Object stores without such a step are not safe
        for several writers.
        """
        system, place = self._of(path)
        hidden = self._hadoop.Path(place.getParent(), f".{uuid.uuid4().hex}")
        stream = system.create(hidden, True)
        stream.write(text.encode())
        stream.close()
        try:
            if replace:
                self._renamed(hidden, place, "OVERWRITE")
            elif system.getScheme() == "file":
                # Renaming looks and then acts there; making a link does both at once.
                os.link(_local(system, hidden), _local(system, place))
            else:
                self._renamed(hidden, place, "NONE")
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if replace or not any(sign in str(error.java_exception) for sign in TAKEN):
                raise
            return False
        finally:
            system.delete(hidden, False)
        return True

    def _renamed(self, old, new, how: str) -> None:
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        chosen = self._jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        chosen[0] = getattr(options, how)
        self._hadoop.FileContext.getFileContext(old.toUri(), self._conf).rename(old, new, chosen)


def _local(system, place) -> str:
    return unquote(urlparse(system.makeQualified(place).toUri().toString()).path)
