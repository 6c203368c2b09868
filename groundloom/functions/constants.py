"""Constants shared by plans and operators."""
CELL_STRIDE = 1048576  # vertex id of cell (i, j) = i * CELL_STRIDE + j
# fixed values: the sixteen winds, clockwise from north
WINDS = (
    "north", "north-northeast", "northeast", "east-northeast", "east", "east-southeast", "southeast", "south-southeast",
    "south", "south-southwest", "southwest", "west-southwest", "west", "west-northwest", "northwest", "north-northwest",
)
