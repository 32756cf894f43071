"""Feature hashing and search over feature counts in the JVM, in vectors of bytes: the source is compiled by Spark's own compiler and sent to executors as a jar."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Chunks are met four vectors of bytes at a time, as one row of bytes a feature. A query adds the rows of its features and
# subtracts those of its negative ones; bytes are widened before a sum can leave them. Pairs whose bound
# leaves 16 bits, and chunks with counts beyond a byte, are added up in 64 bits. Texts are hashed as
# HashEmbedder does; a task remembers hashes of n-grams in a table of fixed size. Tasks of one JVM share the
# bounds that they have reached; what is below one is no best of all tasks, so neither met again nor returned.
SOURCE = """
package spanforge;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.nio.charset.StandardCharsets;
import java.security.MessageDigest;
import java.security.NoSuchAlgorithmException;
import java.util.ArrayList;
import java.util.Arrays;
import java.util.HashMap;
import java.util.Iterator;
import jdk.incubator.vector.ByteVector;
import jdk.incubator.vector.ShortVector;
import jdk.incubator.vector.VectorOperators;
import org.apache.spark.api.java.JavaSparkContext;
import org.apache.spark.api.java.function.MapPartitionsFunction;
import org.apache.spark.broadcast.Broadcast;
import org.apache.spark.sql.Dataset;
import org.apache.spark.sql.Encoders;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;
import org.apache.spark.sql.types.StructType;

public final class CountSearch implements MapPartitionsFunction {
    static final int L = 32, W = 4 * L, F = 32, BATCH = 4096;
    Broadcast shared; // first, middle (places of a query's features and of those that subtract), features, inverse norms, bounds
    int dim, k;
    int[] sizes; // of n-grams
    boolean words;
    double slack, scale;

    static int[] ints(byte[] b) {
        int[] out = new int[b.length / 4];
        ByteBuffer.wrap(b).order(ByteOrder.LITTLE_ENDIAN).asIntBuffer().get(out);
        return out;
    }

    static char[] chars(byte[] b) {
        char[] out = new char[b.length / 2];
        ByteBuffer.wrap(b).order(ByteOrder.LITTLE_ENDIAN).asCharBuffer().get(out);
        return out;
    }

    static double[] doubles(byte[] b) {
        double[] out = new double[b.length / 8];
        ByteBuffer.wrap(b).order(ByteOrder.LITTLE_ENDIAN).asDoubleBuffer().get(out);
        return out;
    }

    public Dataset run(JavaSparkContext context, Dataset chunks, byte[] first, byte[] middle, byte[] features, byte[] inverse, int dim, byte[] sizes, boolean words, int k, double slack, double scale, StructType schema) {
        double[] bound = new double[inverse.length / 8];
        Arrays.fill(bound, Double.NEGATIVE_INFINITY);
        this.shared = context.broadcast(new Object[] {ints(first), ints(middle), chars(features), doubles(inverse), bound});
        this.dim = dim;
        this.sizes = ints(sizes);
        this.words = words;
        this.k = k;
        this.slack = slack;
        this.scale = scale;
        return chunks.mapPartitions((MapPartitionsFunction) this, Encoders.row(schema));
    }

    public Iterator call(Iterator rows) {
        return new Task(this, (Object[]) shared.value()).run(rows);
    }

    /** The hash modulo a period of every feature of a text in lower case with single spaces. */
    static final class Slots {
        static final int BITS = 21, PROBES = 8, CHARS = 4095, WORDS = 1000000;
        final int period;
        final int[] sizes;
        final boolean words;
        final MessageDigest sha;
        final HashMap known = new HashMap();
        final char[] number = new char[0x110000]; // characters are numbered from 1 as they come, so that an n-gram of up to five is one long
        final long[] key = new long[1 << BITS];
        final char[] held = new char[1 << BITS];
        int used = 0, n = 0;
        int[] point = new int[512], at = new int[513], of = new int[512]; // characters, their places in the text and numbers
        char[] out = new char[2048];

        Slots(int period, int[] sizes, boolean words) {
            this.period = period;
            this.sizes = sizes;
            this.words = words;
            try {
                sha = MessageDigest.getInstance("SHA-256");
            } catch (NoSuchAlgorithmException e) {
                throw new IllegalStateException(e);
            }
        }

        char hash(String feature) {
            int rest = 0;
            byte[] digest = sha.digest(feature.getBytes(StandardCharsets.UTF_8));
            for (int i = 0; i < digest.length; i++) rest = (rest << 8 | (digest[i] & 255)) % period;
            return (char) rest;
        }

        void add(char slot) {
            if (n == out.length) out = Arrays.copyOf(out, 2 * n);
            out[n++] = slot;
        }

        char[] of(String text) {
            n = 0;
            if (words) words(text);
            int length = text.length(), chars = 0;
            if (length > point.length) {
                point = new int[2 * length];
                at = new int[2 * length + 1];
                of = new int[2 * length];
            }
            for (int i = 0; i < length; i += Character.charCount(point[chars++])) {
                point[chars] = text.codePointAt(i);
                at[chars] = i;
            }
            at[chars] = length;
            boolean numbered = numbered(chars);
            for (int s = 0; s < sizes.length; s++) {
                int size = sizes[s];
                if (size <= 0) continue;
                if (!numbered || size > 5) {
                    for (int i = 0; i + size <= chars; i++) add(hash("c:" + text.substring(at[i], at[i + size]) + '\\0'));
                    continue;
                }
                long mask = (1L << 12 * size) - 1, k = 0;
                for (int i = 0; i < chars; i++) {
                    k = (k << 12 | of[i]) & mask;
                    if (i + 1 >= size) add(gram(k, text, i + 1 - size, size));
                }
            }
            return Arrays.copyOf(out, n);
        }

        /** Whether the text's characters have numbers; otherwise there are too many. */
        boolean numbered(int chars) {
            for (int again = 0; again < 2; again++) {
                int i = 0;
                for (; i < chars; i++) {
                    if (number[point[i]] == 0) {
                        if (used == CHARS) break;
                        number[point[i]] = (char) ++used;
                    }
                    of[i] = number[point[i]];
                }
                if (i == chars) return true;
                Arrays.fill(number, (char) 0);
                Arrays.fill(key, 0L);
                used = 0;
            }
            return false;
        }

        char gram(long k, String text, int from, int size) {
            int home = (int) (k * 0x9E3779B97F4A7C15L >>> 64 - BITS), place = home;
            for (int p = 0; p < PROBES; p++) {
                place = home + p & (1 << BITS) - 1;
                if (key[place] == k) return held[place];
                if (key[place] == 0) break;
                if (p == PROBES - 1) place = home;
            }
            char slot = hash("c:" + text.substring(at[from], at[from + size]) + '\\0');
            key[place] = k;
            held[place] = slot;
            return slot;
        }

        void words(String text) {
            int length = text.length(), from = -1;
            for (int i = 0; i <= length; i++) {
                char c = i == length ? ' ' : text.charAt(i);
                if ((c >= 'a' && c <= 'z') || (c >= '0' && c <= '9')) {
                    if (from < 0) from = i;
                } else if (from >= 0) {
                    String word = text.substring(from, i);
                    Character slot = (Character) known.get(word);
                    if (slot == null) {
                        if (known.size() >= WORDS) known.clear();
                        slot = Character.valueOf(hash("w:" + word + '\\0'));
                        known.put(word, slot);
                    }
                    add(slot.charValue());
                    from = -1;
                }
            }
        }
    }

    static final class Task {
        final Slots slots;
        final int[] first, middle, held;
        final char[] feature;
        final double[] inverse, bound, score, rounded;
        final long[] position;
        final int dim, k, n;
        final double slack, scale;

        Task(CountSearch of, Object[] queries) {
            first = (int[]) queries[0];
            middle = (int[]) queries[1];
            feature = (char[]) queries[2];
            inverse = (double[]) queries[3];
            dim = of.dim;
            slots = new Slots(2 * dim, of.sizes, of.words);
            k = of.k;
            n = inverse.length;
            slack = of.slack;
            scale = of.scale;
            held = new int[n];
            bound = (double[]) queries[4];
            score = new double[n * k];
            rounded = new double[n * k];
            position = new long[n * k];
        }

        Iterator run(Iterator rows) {
            ArrayList texts = new ArrayList(), places = new ArrayList();
            while (rows.hasNext()) {
                Row row = (Row) rows.next();
                places.add(Long.valueOf(row.getLong(0)));
                texts.add(slots.of(row.getString(1)));
                if (texts.size() == BATCH || !rows.hasNext()) {
                    push(texts, places);
                    texts.clear();
                    places.clear();
                }
            }
            return new Found(this);
        }

        void put(int i, double s, long p) {
            double w = Math.rint(s * scale) / scale;
            int lo = i * k, c = lo + held[i];
            if (held[i] == k) {
                c--;
                if (w < rounded[c] || (w == rounded[c] && p >= position[c])) return;
            } else {
                held[i]++;
            }
            for (; c > lo && (rounded[c - 1] < w || (rounded[c - 1] == w && position[c - 1] > p)); c--) {
                rounded[c] = rounded[c - 1];
                score[c] = score[c - 1];
                position[c] = position[c - 1];
            }
            rounded[c] = w;
            score[c] = s;
            position[c] = p;
            if (held[i] == k) bound[i] = Math.max(bound[i], (rounded[lo + k - 1] - slack) / inverse[i]); // a bound that a task overwrites with a lower one still holds
        }

        void count(char[] slots, int[] into) {
            Arrays.fill(into, 0);
            for (int e = 0; e < slots.length; e++) {
                int s = slots[e];
                if (s < dim) into[s]++; else into[s - dim]--;
            }
        }

        void push(ArrayList texts, ArrayList places) {
            int rows = texts.size();
            int[] count = new int[dim];
            double[] norm = new double[rows];
            boolean[] far = new boolean[rows];
            long[] order = new long[rows]; // chunks met together are of like norms
            for (int r = 0; r < rows; r++) {
                count((char[]) texts.get(r), count);
                double square = 0;
                int top = 0;
                for (int d = 0; d < dim; d++) {
                    square += (double) count[d] * count[d];
                    top = Math.max(top, Math.abs(count[d]));
                }
                norm[r] = square == 0 ? 1 : Math.sqrt(square);
                far[r] = top > 127;
                order[r] = (long) Float.floatToIntBits((float) norm[r]) << 32 | r;
            }
            Arrays.sort(order);
            byte[] tile = new byte[dim * W];
            byte[] most = new byte[dim];
            double[] inv = new double[W];
            long[] pos = new long[W];
            int m = 0;
            for (int o = 0; o < rows; o++) {
                int r = (int) order[o];
                if (far[r]) continue;
                count((char[]) texts.get(r), count);
                for (int d = 0; d < dim; d++) {
                    int c = count[d];
                    if (c != 0) {
                        tile[d * W + m] = (byte) c;
                        if (Math.abs(c) > most[d]) most[d] = (byte) Math.abs(c);
                    }
                }
                inv[m] = 1 / norm[r];
                pos[m++] = ((Long) places.get(r)).longValue();
                if (m == W) {
                    near(tile, most, inv, pos, m);
                    Arrays.fill(tile, (byte) 0);
                    Arrays.fill(most, (byte) 0);
                    m = 0;
                }
            }
            if (m > 0) near(tile, most, inv, pos, m);
            int[] wide = null;
            m = 0;
            for (int o = 0; o < rows; o++) {
                int r = (int) order[o];
                if (!far[r]) continue;
                if (wide == null) wide = new int[dim * F];
                count((char[]) texts.get(r), count);
                for (int d = 0; d < dim; d++) wide[d * F + m] = count[d];
                inv[m] = 1 / norm[r];
                pos[m++] = ((Long) places.get(r)).longValue();
                if (m == F) {
                    for (int i = 0; i < n; i++) far(i, wide, inv, pos, m);
                    m = 0;
                }
            }
            if (m > 0) for (int i = 0; i < n; i++) far(i, wide, inv, pos, m);
        }

        void near(byte[] tile, byte[] most, double[] inv, long[] pos, int m) {
            short[] dots = new short[W];
            double longest = 0, shortest = Double.POSITIVE_INFINITY; // of the inverse norms
            for (int j = 0; j < m; j++) {
                longest = Math.max(longest, inv[j]);
                shortest = Math.min(shortest, inv[j]);
            }
            for (int i = 0; i < n; i++) {
                int most16 = 32767;
                if ((first[i + 1] - first[i]) * 127L > most16) {
                    long total = 0;
                    for (int x = first[i]; x < first[i + 1]; x++) total += most[feature[x]];
                    if (total > most16) {
                        wide(i, tile, inv, pos, m);
                        continue;
                    }
                }
                double reached = bound[i], least = reached > 0 ? reached / longest : reached / shortest;
                int low = (int) Math.max(-32768.0, Math.min(32767.0, Math.ceil(least - 1e-6)));
                if (sums(i, tile, most, (short) low, dots)) {
                    for (int e = 0; e < W; e++) {
                        int dot = dots[e];
                        if (dot < low) continue;
                        int j = (e & -L) + ((e & L / 2 - 1) << 1) + (e & L - 1) / (L / 2);
                        if (j < m && dot * inv[j] >= bound[i]) put(i, dot * (inverse[i] * inv[j]), pos[j]);
                    }
                }
            }
        }

        /** Products of a query with a tile, those of even chunks before those of odd ones in each L; false if all are below low. */
        boolean sums(int i, byte[] tile, byte[] most, short low, short[] dots) {
            int x = first[i], mid = middle[i], end = first[i + 1];
            ShortVector s0 = ShortVector.zero(ShortVector.SPECIES_256), s1 = s0, s2 = s0, s3 = s0, s4 = s0, s5 = s0, s6 = s0, s7 = s0;
            while (x < end) {
                ByteVector a = ByteVector.zero(ByteVector.SPECIES_256), b = a, c = a, d = a;
                int room = 127;
                for (; x < mid; x++) {
                    int f = feature[x], o = f * W;
                    room -= most[f];
                    if (room < 0) break;
                    a = a.add(ByteVector.fromArray(ByteVector.SPECIES_256, tile, o));
                    b = b.add(ByteVector.fromArray(ByteVector.SPECIES_256, tile, o + L));
                    c = c.add(ByteVector.fromArray(ByteVector.SPECIES_256, tile, o + 2 * L));
                    d = d.add(ByteVector.fromArray(ByteVector.SPECIES_256, tile, o + 3 * L));
                }
                if (room >= 0) {
                    for (; x < end; x++) {
                        int f = feature[x], o = f * W;
                        room -= most[f];
                        if (room < 0) break;
                        a = a.sub(ByteVector.fromArray(ByteVector.SPECIES_256, tile, o));
                        b = b.sub(ByteVector.fromArray(ByteVector.SPECIES_256, tile, o + L));
                        c = c.sub(ByteVector.fromArray(ByteVector.SPECIES_256, tile, o + 2 * L));
                        d = d.sub(ByteVector.fromArray(ByteVector.SPECIES_256, tile, o + 3 * L));
                    }
                }
                ShortVector v = a.reinterpretAsShorts();
                s0 = s0.add(v.lanewise(VectorOperators.LSHL, (short) 8).lanewise(VectorOperators.ASHR, (short) 8));
                s1 = s1.add(v.lanewise(VectorOperators.ASHR, (short) 8));
                v = b.reinterpretAsShorts();
                s2 = s2.add(v.lanewise(VectorOperators.LSHL, (short) 8).lanewise(VectorOperators.ASHR, (short) 8));
                s3 = s3.add(v.lanewise(VectorOperators.ASHR, (short) 8));
                v = c.reinterpretAsShorts();
                s4 = s4.add(v.lanewise(VectorOperators.LSHL, (short) 8).lanewise(VectorOperators.ASHR, (short) 8));
                s5 = s5.add(v.lanewise(VectorOperators.ASHR, (short) 8));
                v = d.reinterpretAsShorts();
                s6 = s6.add(v.lanewise(VectorOperators.LSHL, (short) 8).lanewise(VectorOperators.ASHR, (short) 8));
                s7 = s7.add(v.lanewise(VectorOperators.ASHR, (short) 8));
            }
            ShortVector top = s0.max(s1).max(s2.max(s3)).max(s4.max(s5).max(s6.max(s7)));
            if (!top.compare(VectorOperators.GE, low).anyTrue()) return false;
            s0.intoArray(dots, 0);
            s1.intoArray(dots, L / 2);
            s2.intoArray(dots, 2 * L / 2);
            s3.intoArray(dots, 3 * L / 2);
            s4.intoArray(dots, 4 * L / 2);
            s5.intoArray(dots, 5 * L / 2);
            s6.intoArray(dots, 6 * L / 2);
            s7.intoArray(dots, 7 * L / 2);
            return true;
        }

        void wide(int i, byte[] tile, double[] inv, long[] pos, int m) {
            long[] dots = new long[W];
            for (int x = first[i]; x < first[i + 1]; x++) {
                int o = feature[x] * W, sign = x < middle[i] ? 1 : -1;
                for (int j = 0; j < W; j++) dots[j] += sign * tile[o + j];
            }
            for (int j = 0; j < m; j++) if (dots[j] * inv[j] >= bound[i]) put(i, dots[j] * (inverse[i] * inv[j]), pos[j]);
        }

        void far(int i, int[] tile, double[] inv, long[] pos, int m) {
            long[] dots = new long[F];
            for (int x = first[i]; x < first[i + 1]; x++) {
                int o = feature[x] * F;
                long sign = x < middle[i] ? 1 : -1;
                for (int j = 0; j < F; j++) dots[j] += sign * tile[o + j];
            }
            for (int j = 0; j < m; j++) if (dots[j] * inv[j] >= bound[i]) put(i, dots[j] * (inverse[i] * inv[j]), pos[j]);
        }
    }

    static final class Found implements Iterator {
        final Task of;
        int i = 0, at = 0;

        Found(Task of) {
            this.of = of;
        }

        public boolean hasNext() {
            while (i < of.n && (at == of.held[i] || of.rounded[i * of.k + at] < of.bound[i] * of.inverse[i])) {
                i++;
                at = 0;
            }
            return i < of.n;
        }

        public Object next() {
            hasNext();
            int e = i * of.k + at++;
            return RowFactory.create(new Object[] {Integer.valueOf(i), Long.valueOf(of.position[e]), Double.valueOf(of.score[e])});
        }

        public void remove() {
            throw new UnsupportedOperationException();
        }
    }
}
"""
WIDEST = 1 << 15  # dimensions: slots of a feature are then two bytes


def count_search(spark: SparkSession):
    """The compiled class, which executors have as a jar; None where the JVM has no vectors of 256 bits."""
    sc = spark.sparkContext
    held = getattr(sc, "_spanforge_count_search", None)
    if held is None:
        held = sc._spanforge_count_search = (_compiled(spark),)
    return held[0]


def _compiled(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    try:
        bits = min(jvm.jdk.incubator.vector.VectorShape.preferredShape().vectorBitSize(), 512)
        if bits < 256:
            return None
    except TypeError:  # started without that module
        return None
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    compiler.cook(SOURCE.replace("SPECIES_256", f"SPECIES_{bits}").replace("L = 32", f"L = {bits // 8}"))
    path = Path(tempfile.mkdtemp(prefix="spanforge-")) / "count-search.jar"
    with zipfile.ZipFile(path, "w") as jar:
        for name, code in dict(compiler.getBytecodes()).items():
            jar.writestr(name.replace(".", "/") + ".class", bytes(code))
    spark.sparkContext._jsc.sc().addJar(str(path))
    return compiler.getClassLoader().loadClass("spanforge.CountSearch")


def search(chunks: DataFrame, features: np.ndarray, first: np.ndarray, middle: np.ndarray, inverse: np.ndarray, embed, k: int, slack: float, digits: int) -> DataFrame:
    """(place, chunk_pos, score): each task's best k of every query among chunks(chunk_pos, text), the texts as HashEmbedder.flat gives them.

    A query's features are those from its first place; from its middle place on they subtract.
    """
    spark = chunks.sparkSession
    held = [np.ascontiguousarray(x, kind).tobytes() for x, kind in ((first, "<i4"), (middle, "<i4"), (features, "<u2"), (inverse, "<f8"))]
    schema = spark._jsparkSession.parseDataType(StructType.fromDDL("place int, chunk_pos bigint, score double").json())
    found = count_search(spark).getDeclaredConstructor(None).newInstance(None).run(spark.sparkContext._jsc, chunks._jdf, *held, embed.dim, np.array(embed.sizes, "<i4").tobytes(), embed.words, k, float(slack), 10.0**digits, schema)
    return DataFrame(found, spark)
