"""Tables of the video format, as published in RFC 6386, and an encoder's own choices."""

from __future__ import annotations

# Quantizer steps by index 0..127.
DC_STEP = (
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17,
    18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28,
    29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43,
    44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58,
    59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74,
    75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89,
    91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118,
    122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
)
AC_STEP = (
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19,
    20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35,
    36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51,
    52, 53, 54, 55, 56, 57, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76,
    78, 80, 82, 84, 86, 88, 90, 92, 94, 96, 98, 100, 102, 104, 106, 108,
    110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137, 140, 143, 146, 149, 152,
    155, 158, 161, 164, 167, 170, 173, 177, 181, 185, 189, 193, 197, 201, 205, 209,
    213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
)
# Taps of the sub-pixel filters by eighth of a pixel.
SIX_TAP = ((0, 0, 128, 0, 0, 0), (0, -6, 123, 12, -1, 0), (2, -11, 108, 36, -8, 1), (0, -9, 93, 50, -6, 0), (3, -16, 77, 77, -16, 3), (0, -6, 50, 93, -9, 0), (1, -8, 36, 108, -11, 2), (0, -1, 12, 123, -6, 0))
#: Two-tap weights by eighth of a pixel.
TWO_TAP = tuple((128 - 16 * k, 16 * k) for k in range(8))
# Raster place of each coefficient in scan order.
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
# Fixed values, an encoder's choice that the format leaves open: how much each luma coefficient is sharpened.
SHARPENING = (0, 30, 60, 90, 30, 60, 90, 90, 60, 90, 90, 90, 90, 90, 90, 90)
# Fixed values, likewise an encoder's: rounding of DC and AC by kind (luma, second-order luma, chroma), of 256.
ROUNDING = ((96, 110), (96, 108), (110, 115))
# Fixed values, likewise: cost of the four whole-block modes, in 1/256 bit.
LUMA_MODE_COST, CHROMA_MODE_COST = (663, 919, 872, 919), (302, 984, 439, 642)
