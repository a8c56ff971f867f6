"""EXIF out of JPEG and TIFF bytes: named tags of the primary directory, and the place a camera wrote."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

from claimwright.extract.contracts import CONTRACTS, Contract, Findings

# Tag numbers of the format with its names, in the picture's and the camera's, the receiver's and the interoperability directory.
FIELDS = """
100 ImageWidth 101 ImageLength 102 BitsPerSample 103 Compression 106 PhotometricInterpretation 10e ImageDescription 10f Make 110 Model 111 StripOffsets 112 Orientation 115 SamplesPerPixel
116 RowsPerStrip 117 StripByteCounts 11a XResolution 11b YResolution 11c PlanarConfiguration 128 ResolutionUnit 12d TransferFunction 131 Software 132 DateTime 13b Artist 13e WhitePoint
13f PrimaryChromaticities 144 TileOffsets 145 TileByteCounts 201 JPEGInterchangeFormat 202 JPEGInterchangeFormatLength 211 YCbCrCoefficients 212 YCbCrSubSampling 213 YCbCrPositioning
214 ReferenceBlackWhite 8298 Copyright 829a ExposureTime 829d FNumber 8769 ExifIFDPointer 8822 ExposureProgram 8824 SpectralSensitivity 8825 GPSInfoIFDPointer 8827 PhotographicSensitivity
8828 OECF 8830 SensitivityType 8831 StandardOutputSensitivity 8832 RecommendedExposureIndex 8833 ISOSpeed 8834 ISOSpeedLatitudeyyy 8835 ISOSpeedLatitudezzz 9000 ExifVersion
9003 DateTimeOriginal 9004 DateTimeDigitized 9010 OffsetTime 9011 OffsetTimeOriginal 9012 OffsetTimeDigitized 9101 ComponentsConfiguration 9102 CompressedBitsPerPixel
9201 ShutterSpeedValue 9202 ApertureValue 9203 BrightnessValue 9204 ExposureBiasValue 9205 MaxApertureValue 9206 SubjectDistance 9207 MeteringMode 9208 LightSource 9209 Flash
920a FocalLength 9214 SubjectArea 927c MakerNote 9286 UserComment 9290 SubSecTime 9291 SubSecTimeOriginal 9292 SubSecTimeDigitized 9400 Temperature 9401 Humidity 9402 Pressure
9403 WaterDepth 9404 Acceleration 9405 CameraElevationAngle a000 FlashpixVersion a001 ColorSpace a002 PixelXDimension a003 PixelYDimension a004 RelatedSoundFile a005 InteropIFDPointer
a20b FlashEnergy a20c SpatialFrequencyResponse a20e FocalPlaneXResolution a20f FocalPlaneYResolution a210 FocalPlaneResolutionUnit a214 SubjectLocation a215 ExposureIndex
a217 SensingMethod a300 FileSource a301 SceneType a302 CFAPattern a401 CustomRendered a402 ExposureMode a403 WhiteBalance a404 DigitalZoomRatio a405 FocalLengthIn35mmFilm
a406 SceneCaptureType a407 GainControl a408 Contrast a409 Saturation a40a Sharpness a40b DeviceSettingDescription a40c SubjectDistanceRange a420 ImageUniqueID a430 CameraOwnerName
a431 BodySerialNumber a432 LensSpecification a433 LensMake a434 LensModel a435 LensSerialNumber a460 CompositeImage a461 SourceImageNumberOfCompositeImage
a462 SourceExposureTimesOfCompositeImage a500 Gamma"""
RECEIVER = """
0 GPSVersionID 1 GPSLatitudeRef 2 GPSLatitude 3 GPSLongitudeRef 4 GPSLongitude 5 GPSAltitudeRef 6 GPSAltitude 7 GPSTimeStamp 8 GPSSatellites 9 GPSStatus a GPSMeasureMode b GPSDOP
c GPSSpeedRef d GPSSpeed e GPSTrackRef f GPSTrack 10 GPSImgDirectionRef 11 GPSImgDirection 12 GPSMapDatum 13 GPSDestLatitudeRef 14 GPSDestLatitude 15 GPSDestLongitudeRef
16 GPSDestLongitude 17 GPSDestBearingRef 18 GPSDestBearing 19 GPSDestDistanceRef 1a GPSDestDistance 1b GPSProcessingMethod 1c GPSAreaInformation 1d GPSDateStamp 1e GPSDifferential
1f GPSHPositioningError"""
INTEROP = "1 InteroperabilityIndex 2 InteroperabilityVersion 1000 RelatedImageFileFormat 1001 RelatedImageWidth 1002 RelatedImageLength"
#: Where bytes lie in the file, which says nothing about the picture.
LAYOUT = {0x0111, 0x0116, 0x0117, 0x0144, 0x0145, 0x0201, 0x0202, 0x8769, 0x8825, 0xA005}


def _named(table: str) -> dict[int, str]:
    """Tag to its name in lower case with ``-`` between the words."""
    words = table.split()
    return {int(n, 16): re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "-", name).lower() for n, name in zip(words[::2], words[1::2]) if int(n, 16) not in LAYOUT}


TAGS, GPS_TAGS, INTEROP_TAGS = _named(FIELDS), _named(RECEIVER), _named(INTEROP)
KINDS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
SUB_DIRECTORY, GPS_DIRECTORY, INTEROP_DIRECTORY = 0x8769, 0x8825, 0xA005


def _tiff(data: bytes) -> bytes | None:
    if data[:2] == b"\xff\xd8":
        at = data.find(b"Exif\0\0")
        return data[at + 6 :] if at > 0 else None
    return data if data[:4] in (b"II*\0", b"MM\0*") else None


def entries(data: bytes, at: int | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """(tag, kind, count, bytes) of the directory at *at*, else the first; entries that point outside the data are left out."""
    order = "<" if data[:2] == b"II" else ">"
    if at is None:
        at = struct.unpack_from(order + "I", data, 4)[0] if len(data) >= 8 else len(data)
    if at + 2 > len(data):
        return
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        size = SIZES.get(kind, 0) * count
        start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        raw = data[start : start + size]
        if size and len(raw) == size:
            yield tag, kind, count, raw


def _directory(data: bytes, at: int | None = None) -> dict[int, list]:
    """Tag to values of the directory at *at*; opaque bytes are none."""
    order = "<" if data[:2] == b"II" else ">"
    out: dict[int, list] = {}
    for tag, kind, count, raw in entries(data, at):
        if kind == 2:
            parts = raw.split(b"\0")
            out[tag] = [x.decode("utf-8", "replace") for x in (parts if parts[-1] else parts[:-1])]
        elif kind in (5, 10):
            pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
            out[tag] = list(zip(pairs[::2], pairs[1::2]))
        elif kind in KINDS:
            values = list(struct.unpack(order + KINDS[kind] * count, raw))
            if all(math.isfinite(v) for v in values):
                out[tag] = values
    return out


def _value(values: list) -> object:
    """Rationals as ``n/d``, one value bare, several as a list."""
    spelt = [f"{v[0]}/{v[1]}" if isinstance(v, tuple) else v for v in values]
    return spelt[0] if len(spelt) == 1 else spelt


def _directories(data: bytes) -> tuple[dict, dict, dict]:
    tiff = _tiff(data)
    if tiff is None:
        return {}, {}, {}
    first = _directory(tiff)
    within = lambda tags, pointer: _directory(tiff, tags[pointer][0]) if isinstance(tags.get(pointer, [None])[0], int) else {}
    sub = within(first, SUB_DIRECTORY)
    return first | sub, within(first, GPS_DIRECTORY), within(sub, INTEROP_DIRECTORY)


def _fields(tags: dict[int, list], names: dict[int, str]) -> list[tuple[str, object]]:
    return [(f"exif:{names[t]}", _value(v)) for t, v in sorted(tags.items()) if t in names and v]


def image_exif(data: bytes) -> Findings:
    """The named fields of the picture and the camera."""
    tags, _, interop = _directories(data)
    return Findings(_fields(tags, TAGS) + _fields(interop, INTEROP_TAGS))


def image_fields(data: bytes) -> Findings:
    """All named fields of the primary image: those of picture and camera, and the receiver's own."""
    return Findings(image_exif(data).facts + _fields(_directories(data)[1], GPS_TAGS))


def _degrees(values: list, ref: str, top: int) -> float | None:
    if not 1 <= len(values) <= 3 or any(d == 0 for _, d in values) or len(ref) != 1 or ref.upper() not in "NSEW":
        return None
    total = sum(n / d / 60**k for k, (n, d) in enumerate(values))
    return (-total if ref.upper() in "SW" else total) if 0 <= total <= top else None


def geo_position(data: bytes) -> Findings:
    """``geo:position`` of the GPS directory; a note says why there is none where it was meant."""
    _, gps, _ = _directories(data)
    if not gps:
        return Findings()
    if (gps.get(9) or ["A"])[0].upper() == "V":
        return Findings([("prov:note", "position: the receiver had no fix")])
    lat, lon = _degrees(gps.get(2, []), (gps.get(1) or [""])[0], 90), _degrees(gps.get(4, []), (gps.get(3) or [""])[0], 180)
    if lat is None or lon is None:
        return Findings([("prov:note", "position: not readable")])
    place = {"latitude": round(lat, 8), "longitude": round(lon, 8)}
    if 6 in gps and gps[6][0][1]:
        place["altitude"] = gps[6][0][0] / gps[6][0][1] * (-1 if (gps.get(5) or [0])[0] == 1 else 1)
    return Findings([("geo:position", dict(sorted(place.items())))])


CONTRACTS |= {
    c.source: c
    for c in (Contract("extractor:image-exif/2", ("image/jpeg", "image/tiff"), image_fields), Contract("extractor:image-geo/1", ("image/jpeg", "image/tiff"), geo_position))
}
