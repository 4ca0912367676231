"""Multiply-shift hashing of 2-bit k-mer codes: row i of a sketch uses ((a_i * x + b_i) mod 2^64) >> (64 - bits)."""

from __future__ import annotations

import math

import numpy as np

# Multipliers and offsets of the three built-in hash sets (25 rows each)
HASH_SETS: dict[int, tuple[list[int], list[int]]] = {
    1: ([
        1517733481, 5428660835479589707, 4846634552415376859, 6404847846195106823, 7082504985027665327,
        7081795071714822979, 9866633560969882985, 14710122096630180867, 4083536418104953313, 10085560887037081519,
        9657684599635430077, 5375765776848166897, 2360808972908299819, 7250681630747551001, 11003473074184913221,
        8076466398770329967, 6139719934185894223, 11451049086794637917, 8619122089797105967, 13390601433041719853,
        8839741094390848361, 10577078423499430681, 6183755860004429897, 3025424482010352607, 17004177928310018557,
    ], [
        4856492158556586560, 18150631066297409692, 17071671312143097890, 11246878191574502858, 17338235642782036712,
        1727458701145891333, 11294910387947023269, 13949297806502574110, 17272752438476092944, 3248107074795813634,
        5922537472645189238, 15892286188617372710, 8318120239316119536, 16343716287248999037, 14333795491445113305,
        13398482153519806489, 1409391843040956922, 66510355693317130, 3013922286997948648, 15330831926743536898,
        6826576085057777082, 17985603312190364493, 11279862377769237622, 13852582901409633778, 18184946659315698415,
    ]),
    2: ([
        187121373, 2511431304343562723, 7147665428436345271, 3721494656211659017, 9028531757532806933,
        12401019029499314951, 16080865627514826833, 402776020804031653, 8610805722305856557, 12952807613372483653,
        15581649228071459537, 14520345310724849129, 12111067089012895411, 18066810858103403623, 2872946235864730241,
        15638625287209411079, 10925177132098298387, 7581402507076665979, 4557512906746496033, 16934785145779532849,
        2116719500795863651, 9822085442549415677, 6870107060058843499, 10743958474768773521, 1298506336925404333,
    ], [
        8971188853532042230, 6325182366327784716, 6275591155303964276, 14715390152486958894, 12702761475232146710,
        15266937932100600371, 2408571226227901591, 17325463332754345070, 11184575537372294475, 6060057693046191915,
        2351326338454614533, 13790566351358881485, 13542537808996347883, 1139420903880027975, 13684739206904650925,
        2647282317481559886, 6641614377480153390, 17277963026684216469, 5711401825189432063, 6722284676151193032,
        1607587368891218311, 5054120436284156439, 3251466200192997033, 12985719191298216096, 469490828991440354,
    ]),
    3: ([
        3440564993, 6208183799242126737, 13757271343481908477, 8945801451070341587, 16007792826405394403,
        1027394225017363123, 3525937044538061569, 6831725399721252985, 6100030754001587537, 15565666264822266667,
        13403580988819414013, 16388442194190681527, 15439900043822301121, 14730872969127036433, 17507893877636372741,
        17628539803969626061, 16491300322101441493, 11030294364628018399, 10281779409445806959, 12920252808930493277,
        16082838486655860947, 16377602800963860707, 10227175036805121253, 2829561657770814737, 4320018602004207667,
    ], [
        12589259896261028943, 5118218068041137432, 15881037847873053002, 15057295301479589376, 15847630078235206640,
        10318647442273996474, 14965218606940070942, 11687556776720255862, 12692573309166735450, 16337151505370829493,
        10965754989558595602, 16687752933887670036, 8562896084281220660, 18430352550562250709, 3716204860066294188,
        4498041028110365570, 4835626070681416229, 10521089941020280573, 13893041809776693739, 4029776852375354148,
        209526316864103497, 14465039513016333756, 14663614034840330192, 14639539517193443665, 1534251652891572490,
    ]),
}


def floor_power_of_two(m: int) -> int:
    """The largest power of two that isn't above m (at least 1)."""
    return 1 << max(0, int(m).bit_length() - 1)


def are_coprime(x: int, others: list[int]) -> bool:
    return all(math.gcd(x, y) == 1 for y in others)


def random_set(rows: int, seed: int = 0) -> tuple[list[int], list[int]]:
    """Random odd, pairwise coprime multipliers, and random offsets, for `rows` rows."""
    rng = np.random.default_rng(seed)
    draw = lambda: int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
    multipliers: list[int] = []
    while len(multipliers) < rows:
        if are_coprime(x := draw() | 1, multipliers):
            multipliers.append(x)
    return multipliers, [draw() for _ in range(rows)]


def parameters(hash_set: int, rows: int, k: int, bits: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and masked offsets as uint64 for a sketch of `rows` rows of 2^bits cells."""
    if rows < 1 or hash_set != 0 and (hash_set not in HASH_SETS or rows > 25):
        raise ValueError("hash_set is 1, 2 or 3 with up to 25 rows, or 0 for a random one")
    a, b = random_set(rows, seed) if hash_set == 0 else HASH_SETS[hash_set]
    mask = (1 << max(0, 2 * k - bits)) - 1
    return np.array(a[:rows], np.uint64), np.array([x & mask for x in b[:rows]], np.uint64)


def cells(codes: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Cell of every code in every row: (rows, codes)."""
    with np.errstate(over="ignore"):
        return ((a[:, None] * codes[None, :] + b[:, None]) >> np.uint64(64 - bits)).astype(np.int64)
