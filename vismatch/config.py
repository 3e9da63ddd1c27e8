"""Defaults of the jobs and operators, in one place. All are parameters where they are used.

Fixed values: sizes, ratios and thresholds that results depend on.
"""

#: Side of preprocessed images, and of the images that are encoded.
SIZE, QUERY_SIZE = 384, 224
#: Padding around a detected part, and around the foreground of a query image, as a share of the box.
PADDING, QUERY_PADDING = 0.3, 0.06
#: Least share of the image that a foreground covers.
LEAST_FOREGROUND = 0.12
#: Confidence that a detected box needs, and the overlap from which a worse box is dropped.
CONFIDENCE, OVERLAP = 0.25, 0.45
#: Results of a search, parts that are ranked again by their images, and views of a query.
TOP, STAGE_ONE, VIEWS = 5, 200, 3
#: Rows up to which a table is searched whole.
FLAT_ROWS = 100_000
