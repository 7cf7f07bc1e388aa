"""Old word-processor formats, converted with an office suite on the executor that reads them."""

from __future__ import annotations

import glob
import os
import shutil
import subprocess
import tempfile
from pathlib import Path

#: Where office suites are installed.
PLACES = ["/usr/bin/soffice", "/usr/local/bin/soffice", "/opt/libreoffice*/program/soffice", "/snap/bin/libreoffice", "/Applications/LibreOffice.app/Contents/MacOS/soffice", r"C:\Program Files\LibreOffice\program\soffice.exe", r"C:\Program Files (x86)\LibreOffice\program\soffice.exe"]


class ConversionError(RuntimeError):
    pass


def find_soffice(explicit: str = "") -> str | None:
    """The path given, else one on PATH, else a usual place."""
    if explicit:
        return explicit if Path(explicit).is_file() else None
    for name in ("soffice", "libreoffice"):
        if found := shutil.which(name):
            return found
    return next((p for place in PLACES for p in sorted(glob.glob(place)) if os.access(p, os.X_OK)), None)


def convert(content: bytes, file_name: str, soffice: str = "", timeout: int = 120) -> bytes:
    """The file as a Word file. It works in a temporary folder of its own, which always goes."""
    tool = find_soffice(soffice)
    if tool is None:
        raise ConversionError(f"{file_name}: converting needs an office suite (soffice)")
    with tempfile.TemporaryDirectory(prefix="convert-") as folder:
        source = Path(folder, "in", f"document{Path(file_name).suffix.lower()}")
        source.parent.mkdir()
        source.write_bytes(content)
        command = [tool, f"-env:UserInstallation={Path(folder, 'profile').as_uri()}", "--headless", "--convert-to", "docx", "--outdir", f"{folder}/out", str(source)]
        try:
            run = subprocess.run(command, capture_output=True, timeout=timeout, check=False)
        except subprocess.TimeoutExpired:
            raise ConversionError(f"{file_name}: converting took more than {timeout} s") from None
        made = sorted(Path(folder, "out").glob("*.docx"))
        if run.returncode or not made:
            raise ConversionError(f"{file_name}: {run.stderr.decode(errors='replace').strip()[:300] or 'no output'}")
        return made[0].read_bytes()
